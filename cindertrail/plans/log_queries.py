"""Queries over log events: analytics, search, incidents and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.functions import logcols as L
from cindertrail.operators import analytics as A
from cindertrail.operators import bursts as B
from cindertrail.operators import frames as R
from cindertrail.operators import graph as G
from cindertrail.operators import incidents as I
from cindertrail.operators import parallel as P
from cindertrail.search import engine as S
from cindertrail.search.query import parse
from cindertrail.session import table
from cindertrail.sources import demo, samples, simulation
from cindertrail.streaming.detector import batch_readings

FROM_MS, TO_MS = 1_646_870_400_000, 1_646_956_800_000  # 10 March 2022 in UTC
PHRASE, NEAR = "timed out after", "reply sent wth 100 byts"


def logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_events")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "service_calls").select(F.col("caller").alias("source"), F.col("callee").alias("target"))


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    return I.detect_incidents(logs(spark, d))


def _hits(spark: SparkSession, d: str, query: str) -> DataFrame:
    return S.search(logs(spark, d), query).select("id", "matches", "snippet")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    e = simulation.simulate(spark, "traffic-surge", table(spark, d, "service_nodes").select("service", "base_share"))
    return e.groupBy("tick", "phase").agg(F.count("*").alias("events"), F.count_if(L.is_error(F.col("level"))).alias("errors"), F.avg("response_ms").alias("avg_ms"))


def _session(spark: SparkSession, d: str) -> DataFrame:
    e = simulation.simulate(spark, "checkout-5xx-cascade", table(spark, d, "service_nodes").select("service", "base_share"))
    return e.withColumn("session", F.lit("s1"))


QUERIES = {
    "severity_distribution": lambda s, d: A.severity_distribution(logs(s, d)),
    "frequency_analysis": lambda s, d: A.frequency_analysis(logs(s, d)),
    "response_summary": lambda s, d: A.response_summary(logs(s, d)),
    "dataset_stats": lambda s, d: A.dataset_stats(logs(s, d)),
    "service_rollup": lambda s, d: A.service_rollup(logs(s, d)),
    "service_rollup_one": lambda s, d: A.service_rollup(logs(s, d), service="billing"),
    "service_severity": lambda s, d: A.service_severity(logs(s, d)),
    "host_rollup": lambda s, d: A.host_rollup(logs(s, d)),
    "latency_percentiles": lambda s, d: A.latency_percentiles(logs(s, d)),
    "http_stats": lambda s, d: A.http_stats(logs(s, d)),
    "top_error": lambda s, d: A.top_error(logs(s, d)),
    "top_errors": lambda s, d: A.top_errors(logs(s, d)),
    "top_k_service": lambda s, d: A.top_k(logs(s, d), "service", 5),
    "top_k_endpoint": lambda s, d: A.top_k(logs(s, d), "endpoint", 10),
    "top_k_level": lambda s, d: A.top_k(logs(s, d), "level", 10),
    "top_k_ip": lambda s, d: A.top_k(logs(s, d), "ip", 10),
    "histogram_source": lambda s, d: A.histogram(logs(s, d), "source"),
    "distinct_services": lambda s, d: A.distinct_services(logs(s, d)),
    "hour_weekday_heatmap": lambda s, d: A.hour_weekday_heatmap(logs(s, d)),
    "time_windows": lambda s, d: A.time_windows(logs(s, d), 10),
    "timeline_buckets": lambda s, d: A.time_windows(logs(s, d), 24),
    "range_buckets": lambda s, d: A.range_buckets(logs(s, d), FROM_MS, TO_MS, 24),
    "service_activity": lambda s, d: A.service_activity(logs(s, d), "billing"),
    "recent_events": lambda s, d: A.recent_events(logs(s, d), "billing", 50).select("id", "level", "message"),
    "recent_critical": lambda s, d: A.recent_critical(logs(s, d)).select("id", "level", "service", "message"),
    "message_patterns": lambda s, d: A.message_patterns(logs(s, d)),
    "pattern_examples": lambda s, d: A.pattern_examples(logs(s, d), "reply sent with <*> bytes", 200).select("id", "message"),
    "overview": lambda s, d: A.overview(logs(s, d)),
    "search_structured": lambda s, d: _hits(s, d, "level:error level:warn service:billing status:500"),
    "search_phrase": lambda s, d: _hits(s, d, f'"{PHRASE}"'),
    "search_time_range": lambda s, d: logs(s, d).where(S.predicate(parse("level:ERROR", FROM_MS, TO_MS))).select("id", "service", "message"),
    "search_total": lambda s, d: S.total(logs(s, d), "level:warn peer"),
    "explore_page": lambda s, d: S.page(logs(s, d), parse("level:ERROR", sort="service:asc"), 2, 50).select("id", "service"),
    "events_slice": lambda s, d: S.events_slice(logs(s, d), 100, 50).select("id", "message"),
    "event_by_id": lambda s, d: S.event_by_id(logs(s, d), 42).select("id", "message"),
    "typeahead": lambda s, d: S.suggest(logs(s, d), "in", 20),
    "did_you_mean": lambda s, d: S.did_you_mean(logs(s, d), NEAR),
    "fuzzy_lines": lambda s, d: S.fuzzy_lines(logs(s, d), "reply sent with 100 bytes", 2),
    "token_search": lambda s, d: S.token_search(logs(s, d), ["peer", "channel", "billing"]).select("id"),
    "searchable_text": lambda s, d: logs(s, d).select("id", L.searchable_text().alias("text"), L.severity_number(F.col("level")).alias("severity")),
    "render_dataset": lambda s, d: L.render_dataset(logs(s, d)),
    "sample_lines": lambda s, d: samples.sample_lines(s, 2000, malformed=True),
    "service_dependencies": lambda s, d: G.trail_edges(logs(s, d)),
    "node_degrees": lambda s, d: G.nodes(logs(s, d)),
    "top_nodes": lambda s, d: G.top_nodes(logs(s, d)),
    "reachability": lambda s, d: G.reachable(_calls(s, d), "edge-proxy"),
    "blast_radius": lambda s, d: G.blast_radius(_calls(s, d), "ledger-db"),
    "direct_dependents": lambda s, d: G.direct_dependents(_calls(s, d), "ledger-db"),
    "incidents": _incidents,
    "incident_evidence": lambda s, d: I.incident_evidence(logs(s, d), _incidents(s, d)),
    "events_in_window": lambda s, d: I.events_in_window(logs(s, d), FROM_MS, TO_MS, 1000, 10).select("id", "level"),
    "burst_readings": lambda s, d: B.burst_readings(logs(s, d), 3_600_000),
    "latency_baseline": lambda s, d: B.latency_baseline(logs(s, d), 3_600_000),
    "histogram_p95": lambda s, d: B.histogram_p95(logs(s, d)),
    "last_n": lambda s, d: B.last_n(logs(s, d), 500),
    "replay_batches": lambda s, d: B.replay_batches(logs(s, d)),
    "prefix_scan_inclusive": lambda s, d: P.scan(logs(s, d).select("id", "response_ms"), ["id"], "response_ms").select("id", "scan"),
    "prefix_scan_exclusive": lambda s, d: P.scan(logs(s, d).select("id", "response_ms"), ["id"], "response_ms", False).select("id", "scan"),
    "reduce_sum": lambda s, d: P.reduce_column(logs(s, d), "SUM", F.col("response_ms")),
    "reduce_count": lambda s, d: P.reduce_column(logs(s, d), "COUNT", F.col("response_ms")),
    "reduce_max": lambda s, d: P.reduce_column(logs(s, d), "MAX", F.col("response_ms")),
    "reduce_error_count": lambda s, d: P.reduce_column(logs(s, d), "ERROR_COUNT", F.col("status"), 500),
    "sort_latencies": lambda s, d: P.sorted_rows(logs(s, d).select("id", "response_ms").where("response_ms is not null"), ["response_ms", "id"]),
    "demo_events": lambda s, d: demo.demo_events(s).select("id", L.ts_ms().alias("ts_ms"), "service", "level", "host", "response_ms"),
    "simulation_ticks": _ticks,
    "session_frames": lambda s, d: R.frames(_session(s, d), simulation.SIGNATURES, simulation.SCENARIOS["checkout-5xx-cascade"].severity),
    "session_health": lambda s, d: R.health(_session(s, d), table(s, d, "service_nodes")),
    "session_signatures": lambda s, d: R.signature_counts(_session(s, d), simulation.SIGNATURES),
    "session_evidence": lambda s, d: R.evidence(_session(s, d), simulation.SIGNATURES),
    "detector_readings": lambda s, d: batch_readings(logs(s, d)),
}
