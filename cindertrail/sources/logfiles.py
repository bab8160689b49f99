"""Log files: pipe-delimited text and JSON lines, with per-line outcomes."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.operators import imports
from cindertrail.operators.parallel import ranked

DEFAULT_NAME = "imported-logs"
VIEW = "log_events_loaded"


@dataclass
class Loaded:
    """``events`` with ids 0..n-1 in file order, ``failures`` (line_no, raw_message, reason)."""

    name: str
    events: DataFrame
    failures: DataFrame
    counts: DataFrame  # total, success, failure


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line order and text of every line that isn't blank; order is that of the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return lines.where(F.trim("value") != "")


def detect_format(lines: DataFrame) -> str:
    """``jsonl`` if the first line that isn't blank starts with a brace, else ``txt``."""
    first = lines.orderBy("file", "block", "seq").select("value").head(1)
    if not first:
        raise ValueError("the source has no lines")
    return "jsonl" if first[0].value.lstrip().startswith("{") else "txt"


def load(spark: SparkSession, path: str, name: str | None = None, require_events: bool = False) -> Loaded:
    """Parse a file or folder; lines that fail are kept with their reason and get no id."""
    lines = read_lines(spark, path)
    kind = detect_format(lines)
    numbered = ranked(lines, ["file", "block", "seq"]).select(F.col("position").alias("row_id"), F.lit(f"load.{kind}").alias("batch"), F.col("position").alias("row_no"), F.col("value").alias("raw_message"))
    parsed = imports.load_rows(numbered)
    good = ranked(imports.loaded(parsed), ["row_id"]).withColumn("id", F.col("position") - 1).drop("position", "row_id", "batch", "row_no")
    bad = imports.rejected(parsed).join(numbered.select("row_id", "raw_message"), "row_id").select(F.col("row_no").alias("line_no"), "raw_message", "reason")
    ok = F.count_if(F.col("reason").isNull())
    counts = parsed.agg(F.count("*").alias("total"), ok.alias("success"), (F.count("*") - ok).alias("failure"))
    if require_events and good.isEmpty():
        raise ValueError("no line could be parsed")
    return Loaded((name or "").strip() or DEFAULT_NAME, good.select("id", *[c for c in good.columns if c != "id"]), bad, counts)


def ingest(spark: SparkSession, path: str, name: str | None = None, max_bytes: int = 64 << 20) -> Loaded:
    """A file given by a user: refused if it is empty, larger than ``max_bytes`` (0: any size), or holds no event."""
    size = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()[0] or 0
    if size == 0 or 0 < max_bytes < size:
        raise ValueError("the file is empty" if size == 0 else f"files of at most {max_bytes} bytes")
    return load(spark, path, name, require_events=True)


def install(loaded: Loaded, view: str = VIEW) -> None:
    """Make the events the current dataset, replacing any former one at once."""
    loaded.events.createOrReplaceTempView(view)


def current(spark: SparkSession, view: str = VIEW) -> DataFrame:
    if not spark.catalog.tableExists(view):
        raise LookupError("no dataset is loaded")
    return spark.table(view)


def clear(spark: SparkSession, view: str = VIEW) -> bool:
    return spark.catalog.dropTempView(view)


def available_samples(root: str) -> list[str]:
    return sorted(n for n in os.listdir(root) if n != "README.md" and os.path.isfile(os.path.join(root, n)))


def load_sample(spark: SparkSession, root: str, name: str) -> Loaded:
    """A file of the sample folder; names that lead out of it are refused."""
    path = os.path.realpath(os.path.join(root, name))
    if os.path.dirname(path) != os.path.realpath(root):
        raise ValueError("a sample is a file of the sample folder")
    if not os.path.isfile(path):
        raise LookupError(f"no sample {name}")
    return load(spark, f"file://{path}", name)


def wire_projection(events: DataFrame) -> DataFrame:
    """Events with their attributes as a JSON object in order of its keys."""
    pairs = F.from_json("attributes", "map<string,string>")
    return events.withColumn("attributes", F.when(F.col("attributes").isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))))
