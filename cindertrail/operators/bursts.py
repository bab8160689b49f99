"""Sliding-window readings over fixed buckets: bursts, rolling counters, latency baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.logcols import is_error, ts_ms

BINS, BIN_MS = 60, 200


def buckets(events: DataFrame, width_ms: int, by: tuple[str, ...] = ("service",)) -> DataFrame:
    """by..., bucket, events, errors, warnings, p95 source bins; buckets are aligned to the epoch."""
    e = events.where("ts is not null").withColumn("bucket", F.expr(f"unix_millis(ts) div {width_ms}"))
    return e.groupBy(*by, "bucket").agg(
        F.count("*").alias("events"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
        F.count_if(F.col("level") == "WARN").alias("warnings"),
        F.avg(F.when(F.col("response_ms") > 0, F.col("response_ms"))).alias("avg_ms"),
    )


def burst_readings(events: DataFrame, width_ms: int = 1000, lookback: int = 12, ratio: float = 2.2, least: int = 4, by: str = "service") -> DataFrame:
    """by, bucket, errors, baseline, ratio, burst: errors against the mean of the buckets before.

    The baseline is the mean over at most ``lookback`` preceding buckets that hold events;
    without one the ratio is infinite for any error and 0 for none.
    """
    b = buckets(events.where(F.col(by).isNotNull()), width_ms, (by,))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(-lookback, -1)
    out = b.select(by, "bucket", "errors", F.coalesce(F.avg("errors").over(before), F.lit(0.0)).alias("baseline"))
    r = F.when(F.col("baseline") > 0, F.col("errors") / F.nullif(F.col("baseline"), F.lit(0.0))).when(F.col("errors") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("ratio", r).withColumn("burst", (F.col("errors") >= least) & (F.col("ratio") >= ratio))


def latency_baseline(events: DataFrame, width_ms: int = 1000, keep: float = 0.85, by: str = "service") -> DataFrame:
    """by, buckets, baseline_ms: exponentially weighted mean of the buckets' average latency.

    The recurrence new = keep old + (1 - keep) reading is unrolled into weights, so it is one
    grouped sum: the reading i of n weighs (1 - keep) keep^(n - i), the first keep^(n - 1).
    """
    b = buckets(events.where(F.col(by).isNotNull()), width_ms, (by,)).where("avg_ms is not null")
    w = Window.partitionBy(by)
    r = b.withColumn("i", F.row_number().over(w.orderBy("bucket"))).withColumn("n", F.count("*").over(w))
    weight = F.pow(F.lit(keep), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(1 - keep)
    return r.groupBy(by).agg(F.count("*").alias("buckets"), F.sum(weight * F.col("avg_ms")).alias("baseline_ms"))


def histogram_p95(events: DataFrame, by: str = "service", share: float = 0.95) -> DataFrame:
    """by, sampled, p95_ms: upper edge of the 200 ms bin (60 bins, the last one open) that reaches the share."""
    e = events.where((F.col("response_ms") > 0) & F.col(by).isNotNull())
    bins = e.groupBy(by, F.least(F.lit(BINS - 1), F.expr(f"cast(response_ms div {BIN_MS} as int)")).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    cum = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("sampled", F.sum("n").over(w))
    hit = cum.where(F.col("upto") >= F.ceil(F.col("sampled") * share))
    return hit.groupBy(by).agg(F.max("sampled").alias("sampled"), ((F.min("bin") + 1) * BIN_MS).cast("long").alias("p95_ms"))


def last_n(events: DataFrame, n: int = 4000, by: str = "service") -> DataFrame:
    """The newest n rows of each key: by, events, errors, avg_ms, error_pct of that retained window.

    Rows older than the key's n-th newest time can't be among them; the cut is taken from a
    histogram of time slots first, so that only slots near the cut are ranked.
    """
    e = events.where(F.col(by).isNotNull() & F.col("ts").isNotNull()).withColumn("slot", F.expr("unix_millis(ts) div 60000"))
    per = e.groupBy(by, "slot").agg(F.count("*").alias("c"))
    newer = Window.partitionBy(by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    keep = per.withColumn("newer", F.coalesce(F.sum("c").over(newer), F.lit(0))).where(F.col("newer") < n).select(by, "slot", "newer")
    near = e.join(keep, [by, "slot"])
    rank = F.row_number().over(Window.partitionBy(by, "slot").orderBy(F.desc("ts"), F.desc("id"))) + F.col("newer")
    kept = near.withColumn("rank", rank).where(F.col("rank") <= n)
    bad = F.count_if(is_error(F.col("level")))
    return kept.groupBy(by).agg(F.count("*").alias("events"), bad.alias("errors"), F.coalesce(F.avg("response_ms"), F.lit(0.0)).alias("avg_ms"), (bad * 100.0 / F.count("*")).alias("error_pct"))


def replay_batches(events: DataFrame, size: int = 200) -> DataFrame:
    """batch, events, first_id, last_id of a replay in order of time and id, ``size`` rows a batch."""
    from cindertrail.operators.parallel import ranked

    r = ranked(events.where("ts is not null").select(ts_ms().alias("ms"), "id"), ["ms", "id"])
    r = r.withColumn("batch", F.expr(f"cast(1 + (position - 1) div {size} as bigint)"))
    at = F.struct("ms", "id")
    return r.groupBy("batch").agg(F.count("*").alias("events"), F.min(at).alias("a"), F.max(at).alias("z")).select("batch", "events", F.col("a.id").alias("first_id"), F.col("z.id").alias("last_id"))
