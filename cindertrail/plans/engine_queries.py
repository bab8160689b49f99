"""Queries of the algorithm engines, over instances drawn from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrail.functions import logcols as L
from cindertrail.functions import numbers as nums
from cindertrail.operators import engines as E
from cindertrail.operators import graph as G
from cindertrail.operators.parallel import with_previous
from cindertrail.session import table

SOURCE, SINK = "edge-proxy", "ledger-db"
PATTERNS = ["timed out", "time", "out after", "peer", "closed the channel", "channel", "after"]


def logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_events")


def day_edges(spark: SparkSession, d: str) -> DataFrame:
    """Moves between services per day: one network per day."""
    return G.trail_edges(logs(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ("day",))


def day_costs(spark: SparkSession, d: str) -> DataFrame:
    speed = logs(spark, d).where("response_ms between 1 and 100000 and service is not null").groupBy("service").agg(F.floor(F.avg("response_ms")).cast("long").alias("cost"))
    return day_edges(spark, d).join(speed, F.col("target") == F.col("service")).select("day", "source", "target", "weight", "cost")


def host_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).where("service is not null and host is not null and endpoint is not null").select("service", F.col("host").alias("source"), F.col("endpoint").alias("target")).distinct()


def templates(spark: SparkSession, d: str) -> DataFrame:
    """Message templates and their alphabetical neighbour of the same level."""
    t = logs(spark, d).where("message is not null and level is not null").select("level", L.normalize_message(F.col("message")).alias("a")).distinct()
    return with_previous(t, ["level", "a"]).where("previous.level = level").select("level", "a", F.col("previous.a").alias("b"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """service, pos (hour of day), value (events)."""
    return logs(spark, d).where("service is not null").groupBy("service", F.hour("ts").alias("pos")).agg(F.count("*").alias("value"))


def nation_distances(spark: SparkSession, d: str) -> DataFrame:
    """Per region the gaps of mean balance between its nations."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("b"))
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("k")).select("n_regionkey", "n_name", "b")
    m = n.select("n_regionkey", F.col("n_name").alias("target"), F.col("b").alias("b2"))
    return n.join(m, "n_regionkey").where("n_name <> target").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("source"), "target", F.round(F.abs(F.col("b") - F.col("b2")) * 100).cast("long").alias("weight"))


def supplier_trees(spark: SparkSession, d: str) -> DataFrame:
    """Per nation its suppliers as a heap-shaped tree, edges weighted by balance."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, d, "supplier").withColumn("node", F.row_number().over(w) - 1)
    parent = F.when(F.col("node") == 0, -1).otherwise(F.floor((F.col("node") - 1) / 2))
    return s.select(F.col("s_nationkey").alias("nation"), "node", parent.cast("int").alias("parent"), F.round(F.abs("s_acctbal") * 100).cast("long").alias("weight"))


def part_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("weight"), F.round(F.col("p_retailprice") * 100).cast("long").alias("value"))


def _aligned(spark: SparkSession, d: str, local: bool) -> DataFrame:
    t = templates(spark, d)
    return t.select("level", "a", "b", E.alignment("a", "b", local=local).alias("r")).select("level", "a", "b", "r.*")


def _suffixes(spark: SparkSession, d: str) -> DataFrame:
    t = templates(spark, d).select("a").distinct().where(F.length("a") > 0)
    return t.select("a", F.explode(F.arrays_zip(E.suffixes("a").alias("start"), E.suffix_lcp("a").alias("lcp"))).alias("x")).select("a", "x.start", "x.lcp")


def _long_text(spark: SparkSession, d: str) -> DataFrame:
    """All service names after each other as one text, one row per character."""
    n = table(spark, d, "service_nodes").orderBy("service").agg(F.array_join(F.sort_array(F.collect_list("service")), "|").alias("t"))
    return n.select(F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("pos", "ch"))


def _subset_values(spark: SparkSession, d: str) -> DataFrame:
    """Per set of weekdays (a 7-bit mask) the requests seen on exactly these days."""
    e = logs(spark, d).where("request_id is not null and ts is not null").select("request_id", F.pow(F.lit(2), F.weekday("ts")).cast("long").alias("bit")).distinct()
    seen = e.groupBy("request_id").agg(F.sum("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("value"))
    return spark.range(128).select(F.col("id").alias("mask")).join(seen, "mask", "left").select("mask", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


A, B = nums.family(1337)

QUERIES = {
    "pattern_positions": lambda s, d: logs(s, d).select("id", F.explode(L.match_positions(F.col("message"), "ed")).alias("start")),
    "rabin_karp_positions": lambda s, d: logs(s, d).where("message is not null").select("id", F.explode(E.hash_positions("message", F.lit("ed"))).alias("start")),
    "multi_pattern_scan": lambda s, d: E.multi_pattern(logs(s, d), "message", PATTERNS),
    "border_arrays": lambda s, d: templates(s, d).select("level", "a", F.array_join(E.lps("a").cast("array<string>"), ",").alias("lps"), F.array_join(E.z_values("a").cast("array<string>"), ",").alias("z")),
    "rolling_hash": lambda s, d: logs(s, d).where("service is not null").select("service").distinct().select("service", L.polynomial_hash(F.col("service")).alias("hash")),
    "suffix_arrays": _suffixes,
    "suffix_ranks": lambda s, d: E.distributed_suffix_ranks(_long_text(s, d)),
    "suffix_search": lambda s, d: _suffixes(s, d).where(F.expr("substring(a, start + 1, 4) = 'hand'")).select("a", "start"),
    "edit_distance": lambda s, d: templates(s, d).select("level", "a", "b", F.levenshtein("a", "b").alias("distance")),
    "edit_scripts": lambda s, d: templates(s, d).select("level", "a", "b", F.size(F.filter(E.edit_script("a", "b"), lambda op: ~op.startswith("MATCH"))).alias("edits")),
    "damerau_distance": lambda s, d: templates(s, d).select("level", "a", "b", E.damerau("a", "b").alias("distance")),
    "weighted_edit": lambda s, d: templates(s, d).select("level", "a", "b", E.weighted_edit("a", "b", 1, 2, 3).alias("cost")),
    "global_alignment": lambda s, d: _aligned(s, d, False),
    "local_alignment": lambda s, d: _aligned(s, d, True),
    "max_flow_dinic": lambda s, d: E.max_flows(day_edges(s, d), "day", SOURCE, SINK).select("day", "max_flow"),
    "max_flow_edmonds_karp": lambda s, d: E.max_flows(day_edges(s, d), "day", SOURCE, SINK, "edmonds-karp").select("day", "max_flow"),
    "max_flow_ford_fulkerson": lambda s, d: E.max_flows(day_edges(s, d), "day", SOURCE, SINK, "ford-fulkerson").select("day", "max_flow"),
    "min_cut": lambda s, d: E.min_cuts(day_edges(s, d), "day", SOURCE, SINK),
    "flow_edges": lambda s, d: E.flow_edges(day_edges(s, d), "day", SOURCE, SINK),
    "flow_balance": lambda s, d: E.flow_balance(E.flow_edges(day_edges(s, d), "day", SOURCE, SINK), "day"),
    "min_cost_flow": lambda s, d: E.min_cost_flows(day_costs(s, d), "day", SOURCE, SINK),
    "bipartite_matching": lambda s, d: E.matchings(host_endpoints(s, d), "service"),
    "matching_pairs": lambda s, d: E.matching_pairs(host_endpoints(s, d), "service"),
    "vertex_cover": lambda s, d: E.vertex_covers(day_edges(s, d), "day"),
    "complement_graph": lambda s, d: E.complement_graphs(day_edges(s, d), "day"),
    "cover_reductions": lambda s, d: E.cover_reductions(day_edges(s, d), "day"),
    "split_mix": lambda s, d: table(s, d, "supplier").select("s_suppkey", E.mixed("s_suppkey").alias("value")),
    "modular_powers": lambda s, d: table(s, d, "supplier").select("s_suppkey", E.modular_powers("s_suppkey", 65537, 1_000_000_007).alias("power")),
    "tree_subset_sums": lambda s, d: E.tree_subset_sums(supplier_trees(s, d).withColumn("value", 1 + F.col("weight") % 7), "nation"),
    "set_cover": lambda s, d: E.set_covers(host_endpoints(s, d).select("service", F.col("source").alias("set"), F.col("target").alias("item")), "service"),
    "matrix_chain": lambda s, d: E.matrix_chains(hourly(s, d), "service"),
    "optimal_bst": lambda s, d: E.search_trees(hourly(s, d), "service"),
    "tsp": lambda s, d: E.tours(nation_distances(s, d), "region"),
    "hamiltonian_path": lambda s, d: E.hamiltonian_paths(day_edges(s, d), "day"),
    "tree_metrics": lambda s, d: E.trees(supplier_trees(s, d), "nation"),
    "tree_distance_sums": lambda s, d: E.tree_distance_sums(supplier_trees(s, d), "nation"),
    "sum_over_subsets": lambda s, d: E.subset_sums_joined(_subset_values(s, d), 7),
    "knapsack": lambda s, d: E.knapsacks(part_items(s, d), "brand"),
    "primes": lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("n")).where(E.prime("n")),
    "reservoir": lambda s, d: E.reservoirs(logs(s, d).where("service is not null"), "service", "id", 10),
    "universal_hash": lambda s, d: logs(s, d).select("id", L.universal_hash(F.col("id"), A, B, 64).alias("bucket")),
    "hash_statistics": lambda s, d: E.bucket_statistics(logs(s, d), "id", 64),
    "perfect_hash_membership": lambda s, d: E.static_membership(logs(s, d).select("id", "status"), "status", [500, 502, 503, 504, 599]),
}
