"""What a live view shows at every tick of a running session: counters, baselines, signals, evidence, health.

A session's events come in ticks; a frame is taken after each tick, before the second it
belongs to is over. Everything is a window over the ticks of a session, so a session (some
hundred ticks) is the unit of work and sessions run side by side. Events carry session, tick,
intensity, id, service, level, response_ms and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.logcols import error_band, health_state, is_error
from cindertrail.sources.simulation import TICK_MS, phase

#: Ticks a bucket, buckets of the burst baseline, what makes a burst, and the latency bins.
BUCKET_TICKS, LOOKBACK, LEAST, RATIO, BINS, BIN_MS, CEILING_MS = 1000 // TICK_MS, 12, 4, 2.2, 60, 200, 12_000
#: When baselines learn, how much they keep, and the events evidence is taken from and retained.
QUIET, QUIET_FROM, KEEP, EVIDENCE_EVENTS, RETAINED = 0.02, 3, 0.85, 600, 4000
S = "session"


def _latency() -> Column:
    return F.least(F.lit(CEILING_MS), F.greatest(F.lit(0), F.coalesce("response_ms", F.lit(0))))


def _upto(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)


def tick_counters(events: DataFrame) -> DataFrame:
    """session, tick, intensity, events, generated, errors, warnings, tick_errors, avg_ms: counters of the session so far."""
    bad = F.count_if(is_error(F.col("level")))
    per = events.groupBy(S, "tick").agg(
        F.max("intensity").alias("intensity"), F.count("*").alias("events"), bad.alias("tick_errors"), F.count_if(F.col("level") == "WARN").alias("w"), F.sum(_latency()).alias("ms")
    )
    out = per.select("*", F.sum("events").over(_upto(S)).alias("generated"), F.sum("tick_errors").over(_upto(S)).alias("errors"), F.sum("w").over(_upto(S)).alias("warnings"), F.sum("ms").over(_upto(S)).alias("sum_ms"))
    return out.withColumn("avg_ms", F.expr("sum_ms div generated")).drop("w", "ms", "sum_ms")


def tick_p95(events: DataFrame, share: float = 0.95) -> DataFrame:
    """session, tick, p95_ms: upper edge of the latency bin that reaches the share of all events so far."""
    bins = events.groupBy(S, "tick", F.least(F.lit(BINS - 1), F.floor(_latency() / BIN_MS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = events.select(S, "tick").distinct().select(S, "tick", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    cells = grid.join(bins, [S, "tick", "bin"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(_upto(S, "bin")))
    w = Window.partitionBy(S, "tick")
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return cells.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(S, "tick").agg(((F.min("bin") + 1) * BIN_MS).cast("long").alias("p95_ms"))


def burst_of_open_bucket(counters: DataFrame) -> DataFrame:
    """session, tick, bucket, bucket_errors, burst_baseline, burst: the second a tick belongs to, judged as far as it has come."""
    c = counters.select(S, "tick", F.expr(f"tick div {BUCKET_TICKS}").alias("bucket"), "tick_errors")
    before = Window.partitionBy(S).orderBy("bucket").rowsBetween(-LOOKBACK, -1)
    full = c.groupBy(S, "bucket").agg(F.sum("tick_errors").alias("e")).select(S, "bucket", F.coalesce(F.avg("e").over(before), F.lit(0.0)).alias("burst_baseline"))
    out = c.withColumn("bucket_errors", F.sum("tick_errors").over(_upto(S, "bucket"))).join(full, [S, "bucket"])
    ratio = F.when(F.col("burst_baseline") > 0, F.col("bucket_errors") / F.nullif(F.col("burst_baseline"), F.lit(0.0))).otherwise(F.when(F.col("bucket_errors") > 0, F.lit(float("inf"))).otherwise(0.0))
    return out.select(S, "tick", "bucket", "bucket_errors", "burst_baseline", ((F.col("bucket_errors") >= LEAST) & (ratio >= RATIO)).alias("burst"))


def _learn(acc: Column, x: Column) -> Column:
    """One tick of the running baselines: they learn from quiet ticks only, the latency rounded each time."""
    quiet = (x["intensity"] <= QUIET) & (x["tick"] >= QUIET_FROM)
    eps = F.when(quiet, F.when(acc["eps"] == 0, x["eps"]).otherwise(acc["eps"] * KEEP + x["eps"] * (1 - KEEP))).otherwise(acc["eps"])
    smooth = F.floor(acc["p95"] * KEEP + x["p95"] * (1 - KEEP) + 0.5).cast("long")
    p95 = F.when(quiet, F.when(acc["seeded"], smooth).otherwise(x["p95"])).otherwise(acc["p95"])
    return F.struct(
        F.when(eps <= 0, F.greatest(F.lit(1.0), x["eps"])).otherwise(eps).alias("eps"),
        F.when(p95 <= 0, F.greatest(F.lit(1).cast("long"), x["p95"])).otherwise(p95).alias("p95"),
        (acc["seeded"] | quiet).alias("seeded"),
    )


def baselines(counters: DataFrame, p95: DataFrame) -> DataFrame:
    """session, tick, eps, base_eps, base_p95: events a second against their exponentially weighted baselines."""
    eps = (F.col("events") / (TICK_MS / 1000)).alias("eps")
    r = counters.join(p95, [S, "tick"]).select(S, "tick", eps, F.struct("tick", "intensity", eps, F.col("p95_ms").alias("p95")).alias("x"))
    start = F.struct(F.lit(0.0).alias("eps"), F.lit(0).cast("long").alias("p95"), F.lit(False).alias("seeded"))
    r = r.withColumn("b", F.aggregate(F.collect_list("x").over(_upto(S)), start, _learn))  # at most a session's ticks
    return r.select(S, "tick", "eps", F.col("b.eps").alias("base_eps"), F.col("b.p95").alias("base_p95"))


def signature_counts(events: DataFrame, signatures: tuple[str, ...], last: int = EVIDENCE_EVENTS) -> DataFrame:
    """session, tick, signature, hits: occurrences in the messages of the last events up to each tick."""
    order = Window.partitionBy(S).orderBy("tick", "id")
    e = events.select(S, "tick", "message", F.row_number().over(order).alias("place"))
    ends = e.groupBy(S, "tick").agg(F.max("place").alias("end"))
    found = e.select(S, "place", F.explode(F.array(*[F.struct(F.lit(x).alias("signature"), F.regexp_count("message", F.lit(f"(?=\\Q{x}\\E)")).alias("n")) for x in signatures])).alias("f"))
    found = found.where("f.n > 0").select(S, "place", "f.*")
    # An event is among the last ones of the ticks that end within ``last`` places of it: one join on slots of places.
    slots = ends.withColumn("slot", F.explode(F.sequence(F.floor((F.col("end") - last + 1) / last), F.floor(F.col("end") / last))))
    hits = found.withColumn("slot", F.floor(F.col("place") / last)).join(slots, [S, "slot"]).where((F.col("place") <= F.col("end")) & (F.col("place") > F.col("end") - last))
    return hits.groupBy(S, "tick", "signature").agg(F.sum("n").cast("long").alias("hits"))


def frames(events: DataFrame, signatures: tuple[str, ...], severity: str) -> DataFrame:
    """One row per session and tick: phase, counters, rates, baselines, the open bucket and the signals raised.

    Signals: burst, latency (null, MAJOR, or ``severity`` from four times the baseline on), volume,
    signatures seen among the last events; ``band`` of the tick's share of errors.
    """
    c = tick_counters(events)
    p = tick_p95(events)
    hits = signature_counts(events, signatures).groupBy(S, "tick").agg(F.count("*").cast("int").alias("signatures"), F.sum("hits").alias("signature_hits"))
    j = c.join(p, [S, "tick"]).join(baselines(c, p), [S, "tick"]).join(burst_of_open_bucket(c), [S, "tick"]).join(hits, [S, "tick"], "left")
    return j.select(
        S, "tick", phase(F.col("intensity")).alias("phase"), "events", "generated", "errors", "warnings",
        F.round(F.col("errors") * 100.0 / F.col("generated"), 2).alias("error_pct"), error_band(F.col("tick_errors") / F.col("events")).alias("band"), "avg_ms",
        F.least(F.col("generated"), F.lit(RETAINED)).alias("retained"), "eps", F.round("base_eps", 6).alias("base_eps"), "p95_ms", F.col("base_p95").alias("base_p95_ms"),
        "bucket", "bucket_errors", F.round("burst_baseline", 6).alias("burst_baseline"), "burst",
        F.when(F.col("p95_ms") >= 4 * F.col("base_p95"), severity).when(F.col("p95_ms") >= 2 * F.col("base_p95"), "MAJOR").alias("latency_signal"),
        (F.col("eps") >= 2 * F.col("base_eps")).alias("volume_signal"),
        F.coalesce("signatures", F.lit(0)).alias("signatures"), F.coalesce("signature_hits", F.lit(0)).alias("signature_hits"),
    )


def health(events: DataFrame, topology: DataFrame) -> DataFrame:
    """session, tick, service, tier, events, errors, error_pct, avg_ms, state, load of every declared service; silent ones count zero.

    Counters are those of the session so far; ``load`` is the share of the busiest service's events.
    """
    c = tick_counters(events)
    base = baselines(c, tick_p95(events)).select(S, "tick", "base_p95")
    per = events.groupBy(S, "tick", "service").agg(F.count("*").alias("n"), F.count_if(is_error(F.col("level"))).alias("e"), F.sum(_latency()).alias("ms"))
    declared = topology.agg(F.sort_array(F.collect_list(F.struct("service", "tier"))).alias("d")).scalar()  # a fleet, not data
    grid = base.withColumn("d", F.explode(declared)).select(S, "tick", "base_p95", "d.service", "d.tier")
    j = grid.join(per, [S, "tick", "service"], "left")
    sums = {"events": "n", "errors": "e", "ms": "ms"}
    j = j.select(S, "tick", "service", "tier", "base_p95", *[F.sum(F.coalesce(v, F.lit(0))).over(_upto(S, "service")).alias(k) for k, v in sums.items()])
    j = j.withColumn("error_pct", F.when(F.col("events") == 0, 0.0).otherwise(F.col("errors") * 100.0 / F.col("events")))
    j = j.withColumn("avg_ms", F.when(F.col("events") == 0, 0).otherwise(F.expr("ms div nullif(events, 0)")))
    most = F.max("events").over(Window.partitionBy(S, "tick"))
    load = F.when(most == 0, 0.0).otherwise(F.col("events") / F.nullif(most, F.lit(0)))
    return j.select(S, "tick", "service", "tier", "events", "errors", F.round("error_pct", 6).alias("error_pct"), "avg_ms", health_state(F.col("error_pct"), F.col("avg_ms"), F.col("base_p95")).alias("state"), F.round(load, 6).alias("load"))


def evidence(events: DataFrame, signatures: tuple[str, ...]) -> DataFrame:
    """session, tick, algorithm, subject, amount: what each signal rests on.

    multi-scan: signatures found among the last events; recount: the most frequent one counted
    again; window: errors of the open bucket.
    """
    hits = signature_counts(events, signatures)
    top = hits.groupBy(S, "tick").agg(F.min_by("signature", F.struct((-F.col("hits")).alias("h"), "signature")).alias("subject"), F.max("hits").alias("amount"))
    scan = hits.groupBy(S, "tick").agg(F.count("*").alias("k"), F.sum("hits").alias("amount"))
    window = burst_of_open_bucket(tick_counters(events))
    rows = scan.select(S, "tick", F.lit("multi-scan").alias("algorithm"), F.col("k").cast("string").alias("subject"), "amount")
    rows = rows.unionByName(top.select(S, "tick", F.lit("recount").alias("algorithm"), "subject", "amount"))
    return rows.unionByName(window.select(S, "tick", F.lit("window").alias("algorithm"), F.col("bucket").cast("string").alias("subject"), F.col("bucket_errors").alias("amount")))
