"""Repeated consecutive events collapsed into one row per run.

Within an entity, the row number among all events minus the row number among the events of
the same canonical value is constant exactly along a run. Both numbers are taken within
ranges of the (entity, time, id) order, so an entity with a third of all rows is spread over
many tasks; runs that touch the edge of a range are then joined with equal neighbours, of
which there are at most two per entity and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import row_digest
from cindertrail.session import materialise


def canonical_message(message: Column) -> Column:
    """Equal for messages that differ only in case, white space, closing . and !, and words with a digit."""
    m = F.regexp_replace(F.lower(message), r"[\s .!]+$", "")
    m = F.regexp_replace(m, r"[^\s ]*\p{Nd}[^\s ]*", "\u0001")
    return F.btrim(F.regexp_replace(m, r"[\s ]+", " "))


def collapse_runs(
    events: DataFrame,
    entity: str = "service",
    ts: str = "ts",
    row_id: str = "id",
    value: Column | None = None,
    min_events: int = 1,
    copy_ignores: tuple[str, ...] = ("id", "ingested_at"),
) -> DataFrame:
    """entity, first_id, last_id, events, start_us, end_us, duration_us of every run.

    Rows without entity or time are left out; a null value equals other nulls and nothing
    else; of copies (equal in all columns but ``copy_ignores``) the smallest id stands; ties
    in time are ordered by id. Runs under ``min_events`` are left out.
    """
    h1, h2 = row_digest(events, copy_ignores)
    v = value if value is not None else canonical_message(F.col("message"))
    rows = events.where(F.col(f"`{entity}`").isNotNull() & F.col(f"`{ts}`").isNotNull()).select(
        F.col(f"`{entity}`").alias("entity"),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("us"),
        F.col(f"`{row_id}`").alias("id"),
        F.xxhash64(F.lit(3), v.isNull(), v).alias("v1"),
        F.xxhash64(F.lit(71993), v.isNull(), v).alias("v2"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    once = rows.groupBy("h1", "h2", "entity", "us", "v1", "v2").agg(F.min("id").alias("id")).drop("h1", "h2")
    ranged = once.repartitionByRange("entity", "us", "id").withColumn("part", F.spark_partition_id())
    order = (F.col("us"), F.col("id"))
    ranged = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("part", "entity").orderBy(*order)))
    ranged = ranged.withColumn("step", F.col("rn") - F.row_number().over(Window.partitionBy("part", "entity", "v1", "v2").orderBy(*order)))
    at = F.struct("us", "id")
    local = ranged.groupBy("part", "entity", "v1", "v2", "step").agg(
        F.count("*").alias("events"), F.min(at).alias("first"), F.max(at).alias("last"), F.min("rn").alias("from_rn"), F.max("rn").alias("to_rn")
    )
    local = local.withColumn("end_rn", F.max("to_rn").over(Window.partitionBy("part", "entity")))
    edge = (F.col("from_rn") == 1) | (F.col("to_rn") == F.col("end_rn"))
    local = local.withColumn("edge", edge).where(F.col("edge") | (F.col("events") >= min_events))
    local = materialise(local.select("part", "entity", "v1", "v2", "events", "first", "last", "from_rn", "edge"), "runs")
    inner = local.where(~F.col("edge")).select("entity", "events", "first", "last")
    line = Window.partitionBy("entity").orderBy("part", "from_rn")
    joins = (F.lag("part").over(line) < F.col("part")) & (F.lag("v1").over(line) == F.col("v1")) & (F.lag("v2").over(line) == F.col("v2"))
    outer = (
        local.where("edge")
        .withColumn("opens", F.when(joins, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "run")
        .agg(F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("run")
        .select("entity", "events", "first", "last")
    )
    return (
        inner.unionByName(outer)
        .where(F.col("events") >= min_events)
        .select(
            F.col("entity").alias(entity),
            F.col("first.id").alias("first_id"),
            F.col("last.id").alias("last_id"),
            "events",
            F.col("first.us").alias("start_us"),
            F.col("last.us").alias("end_us"),
            (F.col("last.us") - F.col("first.us")).alias("duration_us"),
        )
    )
