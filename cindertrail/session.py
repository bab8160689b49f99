"""Session factory and the helpers every plan shares: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "cindertrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, which run its Python functions."""
    root = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), os.path.basename(root)), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)  # the driver serves it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where the
    driver is the only machine, falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), f"cindertrail-{os.getpid()}")
    return f"file://{own}"


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage with replicated storage: a lost executor costs a re-read, never a
    recomputation of a result another stage has already seen. The table lives until the
    ``scratch`` it was written in is left, or else the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cindertrail/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are removed at the end; results must have been read or saved by then."""
    kept = list(_paths)
    try:
        yield
    finally:
        fresh = [p for p in _paths if p not in kept]
        _forget(fresh)
        _paths[:] = [p for p in _paths if p not in fresh]


_paths: list[tuple[SparkSession, str]] = []


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _paths:
        atexit.register(_forget_all)
    _paths.append((spark, path))


def _forget_all() -> None:
    _forget(_paths)
    _paths.clear()


def _forget(paths: list[tuple[SparkSession, str]]) -> None:
    for spark, path in paths:
        if path.startswith("file:/"):  # also once the session has been stopped
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            continue
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may already be gone
            pass
