"""Service dependency graphs from request trails, and reachability over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.session import materialise


def trail_edges(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """source, target, weight (and ``extra`` columns): moves of requests between services."""
    w = Window.partitionBy("request_id").orderBy(F.unix_millis("ts"), "id")
    hops = events.where("request_id is not null and service is not null").select(*extra, "request_id", "ts", "id", F.col("service").alias("target"))
    hops = hops.withColumn("source", F.lag("target").over(w)).where("source is not null and source <> target")
    return hops.groupBy(*extra, "source", "target").agg(F.count("*").alias("weight"))


def nodes(events: DataFrame) -> DataFrame:
    """service, events, in_degree, out_degree: degrees count distinct neighbours."""
    edges = trail_edges(events)
    counts = events.where("service is not null").groupBy("service").agg(F.count("*").alias("events"))
    out = edges.groupBy(F.col("source").alias("service")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("service")).agg(F.count("*").alias("in_degree"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")]
    return counts.join(out, "service", "left").join(into, "service", "left").select("service", "events", *zero)


def top_nodes(events: DataFrame, limit: int = 5) -> DataFrame:
    return events.where("service is not null").groupBy("service").agg(F.count("*").alias("events")).orderBy(F.desc("events"), F.desc("service")).limit(limit)


def reachable(edges: DataFrame, origin: str, max_hops: int = 1000) -> DataFrame:
    """origin, service, hops of everything reachable from ``origin`` (itself at 0 hops).

    Frontier joins: each round extends only services found in the round before and drops those
    known already; rounds end when none is new. A graph deeper than ``max_hops`` is an error,
    never a partial answer. An origin without edges reaches nothing.
    """
    e = materialise(edges.where("source is not null and target is not null").select("source", "target").distinct(), "edges")
    start = e.select(F.col("source").alias("service")).unionAll(e.select("target")).where(F.col("service") == origin).distinct()
    known = frontier = materialise(start.withColumn("hops", F.lit(0)), "reach")
    for hop in range(1, max_hops + 2):
        step = frontier.join(e, frontier["service"] == e["source"]).select(F.col("target").alias("service")).distinct()
        fresh = materialise(step.join(known, "service", "left_anti").withColumn("hops", F.lit(hop)), "reach")
        if fresh.isEmpty():
            break
        if hop > max_hops:
            raise ValueError(f"more than {max_hops} hops from {origin}")
        known, frontier = known.unionByName(fresh), fresh
    return known.select(F.lit(origin).alias("origin"), "service", "hops")


def blast_radius(edges: DataFrame, origin: str) -> DataFrame:
    """origin, service, hops: the callers, direct or not, that a fault of ``origin`` can hit."""
    return reachable(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), origin)


def direct_dependents(edges: DataFrame, service: str) -> DataFrame:
    return edges.where(F.col("target") == service).select(F.col("source").alias("service")).distinct()
