"""Percentiles of very large numeric columns by cumulative frequencies.

Rows are reduced to (group, value, count) first, which is where skew ends: a hot group
shrinks to its distinct values. That frequency table is also the mergeable summary: tables
of days, files or partitions are added up by ``merge_frequencies``. It is range-sorted by
group and value, each range gets running sums, the totals of the ranges before it are added
as an offset, and the first value whose cumulative count reaches rank ceil(p n) is taken.

The error is zero by default. With ``relative_error`` e > 0 values are rounded onto a
geometric grid, so that a frequency table has O(log(max) / e) rows per group whatever the
data, and every percentile is within a factor 1 +- e of the exact one.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.session import materialise


def frequencies(rows: DataFrame, by: tuple[str, ...], value: str, relative_error: float = 0.0) -> DataFrame:
    """by..., value, n. Null values are not counted; null groups are groups of their own."""
    v = F.col(f"`{value}`")
    if relative_error > 0:
        base = math.log((1 + relative_error) / (1 - relative_error))
        cell = F.floor(F.log(v.cast("double")) / F.lit(base))
        v = F.when(v > 0, F.exp((cell + 0.5) * F.lit(base))).otherwise(v.cast("double"))
    return rows.where(F.col(f"`{value}`").isNotNull()).select(*by, v.alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))


def merge_frequencies(*tables: DataFrame) -> DataFrame:
    """The frequency table of all rows of several frequency tables."""
    union = reduce(lambda a, b: a.unionByName(b), tables)
    return union.groupBy(*[c for c in union.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(freq: DataFrame, by: tuple[str, ...], probs: dict[str, float]) -> DataFrame:
    """by..., n and one column per name in ``probs``: the value at rank ceil(p n), p in (0, 1].

    An empty table gives no groups; ties are one value with their count.
    """
    ranged = (
        freq.select(*by, "value", "n")
        .repartitionByRange(*by, "value")
        .sortWithinPartitions(*by, "value")
        .withColumn("part", F.spark_partition_id())
    )
    ranged = materialise(ranged, "frequencies")  # the ranges must be the same for sums and offsets
    running = Window.partitionBy("part", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("upto", F.sum("n").over(running))
    totals = ranged.groupBy("part", *by).agg(F.sum("n").alias("of_part"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        *by,
        F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("offset"),
        F.sum("of_part").over(Window.partitionBy(*by)).alias("total"),
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by] + [F.col("l.part") == F.col("o.part")]
    ranked = local.alias("l").join(offsets.alias("o"), same).select(*[F.col(f"l.{c}") for c in by], "value", "n", "total", (F.col("upto") + F.col("offset")).alias("upto"))
    picks = []
    for name, p in probs.items():
        q = Fraction(p).limit_denominator(1_000_000)
        rank = F.greatest(F.lit(1), F.floor((F.col("total") * q.numerator + (q.denominator - 1)) / F.lit(q.denominator).cast("decimal(20,0)")))
        hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        picks.append(F.min(F.when(hit, F.col("value"))).alias(name))
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), *picks)
