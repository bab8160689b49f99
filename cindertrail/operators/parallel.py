"""Reduce, prefix scan and sort over distributed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.session import materialise


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order`` with their range in ``part``, written once."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return materialise(cut, "ranges")


def scan(df: DataFrame, order: list[str], value: str, inclusive: bool = True) -> DataFrame:
    """Rows with ``scan``, the running sum of ``value`` in total order, in two phases.

    Running sums within ranges, plus the total of all ranges before: no single task sees all
    rows. ``order`` must be unique for a defined result; null values add 0.
    """
    r = ranged(df, order)
    v = F.coalesce(F.col(value), F.lit(0))
    totals = r.groupBy("part").agg(F.sum(v).alias("s"))  # one row per range
    offsets = totals.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.sum(v).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = r.withColumn("within", within).join(offsets, "part")
    total = F.col("within") + F.col("offset")
    return out.withColumn("scan", total if inclusive else total - v).drop("part", "within", "offset")


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``position``, 1 for the first in total order."""
    return scan(df.withColumn("__one", F.lit(1).cast("long")), order, "__one").withColumnRenamed("scan", "position").drop("__one")


def reduce_column(df: DataFrame, op: str, value: Column, marker: int = 1) -> DataFrame:
    """One row: SUM (null past the largest long), COUNT of positive values, MAX, or ERROR_COUNT of ``marker``."""
    op = op.upper()
    v = value.cast("long")
    agg = {"SUM": F.try_sum(v), "COUNT": F.count_if(v > 0), "MAX": F.max(v), "ERROR_COUNT": F.count_if(v == marker)}
    if op not in agg:
        raise ValueError(f"unknown reduction {op}")
    return df.agg(agg[op].cast("long").alias("result"))


def sorted_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """A total sort: range exchange and local sorts."""
    return df.orderBy(*order)


def with_previous(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``previous``, the ``order`` columns of the row before in total order, null for the first.

    Rows are sorted in ranges; only the last row of each range travels to the range behind it.
    """
    r = ranged(df, order)
    at = F.struct(*order)
    ends = r.groupBy("part").agg(F.max(at).alias("last"))  # one row per range
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    within = F.lag(at).over(Window.partitionBy("part").orderBy(*order))
    return r.withColumn("within", within).join(ends, "part").withColumn("previous", F.coalesce("within", "before")).drop("part", "within", "before")
