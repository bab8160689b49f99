"""Seeded sample files of log lines: well-formed, malformed in four ways, or as request chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import unit
from cindertrail.sources.demo import SERVICES

LEVELS = ("INFO", "INFO", "DEBUG", "WARN", "ERROR")
#: Share of lines broken in each of the four ways: time, fields, level, delimiter.
BROKEN = 1 / 25
#: 13 September 2026, midnight in UTC.
ORIGIN_MS = 1_789_257_600_000


def sample_lines(spark: SparkSession, n: int, malformed: bool = False, hops: int = 1, seed: int = 42) -> DataFrame:
    """line_no (from 1), line: n lines of eleven fields, a millisecond apart; ``hops`` lines share a request id."""
    u = lambda salt: unit(seed, salt, F.col("id"))
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (u(salt) * len(of)).cast("int") + 1)
    at = F.date_format(F.timestamp_millis(F.lit(ORIGIN_MS) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    chain = F.floor(F.col("id") / hops).cast("string")
    service = F.when(F.col("id") % hops == 0, F.lit(SERVICES[0])).otherwise(pick(2, SERVICES)) if hops > 1 else pick(2, SERVICES)
    way = F.floor(u(9) / BROKEN) if malformed else F.lit(9)
    fields = [
        F.when(way == 0, F.lit("not-a-time")).otherwise(at), F.when(way == 2, F.lit("ALERT")).otherwise(pick(1, LEVELS)), service,
        F.concat(F.lit("192.0.2."), (u(3) * 254 + 1).cast("int").cast("string")), pick(4, ("GET", "POST", "PUT")), F.lit("/v1/items"), pick(5, ("200", "404", "500")),
        (u(6) * 900).cast("int").cast("string"), F.concat(F.lit("req-"), chain), F.when(u(7) < 0.2, "-").otherwise(F.concat(F.lit("user-"), (u(8) * 500).cast("int").cast("string"))),
        F.concat(F.lit("handled request "), chain, F.when(way == 3, " | again").otherwise("")),
    ]
    line = F.when(way == 1, F.concat_ws(" | ", *fields[:4])).otherwise(F.concat_ws(" | ", *fields))
    return spark.range(n).select((F.col("id") + 1).alias("line_no"), line.alias("line"))


def write_sample(lines: DataFrame, path: str) -> None:
    """One text file, its lines in order."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
