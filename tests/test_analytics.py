import pytest
from pyspark.sql import functions as F

from cindertrail.functions import logcols as L
from cindertrail.operators import analytics as A
from cindertrail.operators import bursts as B
from cindertrail.operators import graph as G
from cindertrail.operators import incidents as I
from cindertrail.operators import parallel as P
from cindertrail.search import engine as S
from cindertrail.search.query import parse, split_tokens


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_severity_is_zero_filled(logs):
    got = [(r.level, r.events) for r in A.severity_distribution(logs([{"level": "WARN"}, {"level": None}])).orderBy("ord").collect()]
    assert got == [("TRACE", 0), ("DEBUG", 0), ("INFO", 0), ("WARN", 1), ("ERROR", 0), ("FATAL", 0)]


def test_rollups(logs):
    df = logs([{"level": "ERROR", "service": "a", "host": "h", "ts": 5}, {"level": "WARN", "service": "a", "ts": 9}, {"level": "FATAL"}])
    by = {r.name: r for r in A.service_rollup(df).collect()}
    assert (by["a"].events, by["a"].errors, by["a"].warnings, by["a"].error_rate_pct, by["a"].hosts, by["a"].latest_ms) == (2, 1, 1, 50.0, 1, 9000)
    assert by["(unknown)"].errors == 1 and {r.host for r in A.host_rollup(df).collect()} == {"h", "(no host)"}
    assert A.service_rollup(df, 1).first().name == "a"


def test_nearest_rank_percentiles(logs):
    df = logs([{"service": "a", "response_ms": v} for v in (0, 10, 20, 30, 40)])
    r = A.latency_percentiles(df).first()
    assert (r.sampled, r.p50_ms, r.p95_ms, r.p99_ms) == (4, 20, 40, 40)


def test_top_k_ties_and_limits(logs):
    df = logs([{"service": s} for s in "aabbc"])
    assert [r.key for r in A.top_k(df, "service", 2).collect()] == ["b", "a"]
    assert A.top_k(df, "service", 0).collect() == []


def test_windows_cover_the_span(logs):
    got = A.time_windows(logs([{"ts": t} for t in (0, 1, 9, 10)]), 5).orderBy("bucket").collect()
    assert len(got) == 5 and sum(r.events for r in got) == 4 and got[0].start_ms == 0 and all(a.end_ms + 1 == b.start_ms for a, b in zip(got, got[1:]))
    assert A.time_windows(logs([]), 5).collect() == []
    r = A.range_buckets(logs([{"ts": 10}]), 0, 10_000, 3).orderBy("bucket").collect()
    assert [x.events for x in r] == [0, 0, 1]


def test_overview_of_the_latest_window(logs):
    got = {(r.section, r.key): r.value for r in A.overview(logs([{"ts": 0, "level": "INFO"}, {"ts": 90_000, "level": "ERROR", "service": "a", "message": "m 1"}]), "24h").collect()}
    assert got["totals", "events"] == 1 and got["severity", "ERROR"] == 1 and got["pattern", "m <*>"] == 1


@pytest.mark.parametrize(
    "message, template",
    [("user 42 in", "user <*> in"), ("id deadbeef-cafe x", "id <*> x"), ("a, b!", "a b"), ("see #tag {x} $y", "see <*> <*> <*>"), ("beef", "beef"), ("  a  b ", "a b")],
)
def test_message_templates(spark, message, template):
    assert spark.createDataFrame([(message,)], "m string").select(L.normalize_message(F.col("m"))).first()[0] == template


def test_patterns_take_first_example(logs):
    df = logs([{"message": "x 2", "level": "WARN"}, {"message": "x 1", "level": "INFO"}, {"message": "y"}])
    assert [(r.template, r["count"], r.example, r.level) for r in A.message_patterns(df, 5).collect()] == [("x <*>", 2, "x 2", "WARN"), ("y", 1, "y", None)]
    with pytest.raises(ValueError):
        A.message_patterns(df, 5, "LOUD")


def test_incidents_find_a_dense_burst(logs):
    quiet = [{"ts": t, "level": "ERROR", "service": "b", "message": "m"} for t in range(0, 86_400, 7200)]
    dense = [{"ts": 40_000 + t, "level": "ERROR", "service": "a", "message": f"lost {t}"} for t in range(30)]
    (r,) = I.detect_incidents(logs(quiet + dense)).collect()
    assert r.errors >= 29 and r.services.startswith("a") and r.pattern == "lost <*>" and r.end_ms - r.start_ms <= 600_000
    assert I.detect_incidents(logs(quiet)).collect() == [] and I.detect_incidents(logs([])).collect() == []


def test_trail_edges_skip_same_service_and_missing(logs):
    df = logs([{"request_id": "r", "ts": t, "service": s} for t, s in enumerate(["a", "a", None, "b", "a"])] + [{"service": "z", "ts": 1}])
    assert rows(G.trail_edges(df)) == {("a", "b", 1), ("b", "a", 1)}
    assert rows(G.nodes(df)) == {("a", 3, 1, 1), ("b", 1, 1, 1), ("z", 1, 0, 0)}


def test_reachability_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d")], "source string, target string")
    assert rows(G.reachable(e, "a")) == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}
    assert rows(G.reachable(e, "d")) == {("d", "d", 0)} and ("b", "a", 2) in rows(G.reachable(e, "b")) and rows(G.reachable(e, "z")) == set()
    assert ("d", "a", 3) in rows(G.blast_radius(e, "d"))
    with pytest.raises(ValueError, match="more than 2 hops"):
        G.reachable(e, "a", max_hops=2)


def test_value_ranks(logs):
    df = logs([{"service": "s", "response_ms": v} for v in (5, 1, 1, 9, 7)])
    assert rows(A.latency_percentiles(df)) == {("s", 5, 5, 9, 9)}
    assert {(r.key, r.value) for r in A.http_stats(logs([])).where("section = 'latency'").collect()} == {("p50", 0), ("p95", 0), ("max", 0), ("sampled", 0)}


def test_neighbours_over_ranges(spark):
    from cindertrail.operators.parallel import with_previous

    got = with_previous(spark.range(0, 500, 1, 7).withColumn("k", F.col("id") % 3).repartition(5), ["k", "id"]).collect()
    order = sorted((r.k, r.id) for r in got)
    assert {(r.k, r.id): r.previous and tuple(r.previous) for r in got} == dict(zip(order, [None, *order[:-1]]))


def test_incident_windows_at_the_boundary(logs):
    """A span of whole windows has one window more, which holds the last error."""
    errors = [{"ts": 0, "level": "ERROR", "service": "a", "message": "m"}] * 3 + [{"ts": 300, "level": "ERROR", "service": "a", "message": "m"}]
    (r,) = I.detect_incidents(logs(errors), least=2, factor=1.0).collect()
    assert (r.baseline, r.threshold, r.errors, r.incident_id) == (2.0, 2, 3, 1)


def test_query_language():
    assert split_tokens('a "b c" d:"e f" ""') == ["a", "b c", "d:e f", ""]
    q = parse('level:error level:WARN service:x service:y "timed out" message:now foo:bar', 1, 2, "level:asc")
    assert (q.levels, q.exact, q.phrase, q.sort, q.ascending) == (["error", "WARN"], {"service": "y"}, "timed out now foo:bar", "level", True)
    for bad in ("level:", "host:  "):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        parse("", 5, 4)


def test_search(logs):
    df = logs([{"level": "ERROR", "service": "s", "message": "aaAa x"}, {"level": "INFO", "service": "s", "message": "b"}, {"level": None, "message": "aa"}])
    assert [(r.id, r.matches) for r in S.search(df, "aa").orderBy("id").collect()] == [(0, 3), (2, 1)]
    assert S.search(df, "level:LOUD").count() == 0 and S.search(df, "status:0").count() == 0
    assert [r.id for r in S.page(df, parse("", sort="id:asc"), 2, 2).collect()] == [2] and S.page(df, "", 9, 2).count() == 0
    with pytest.raises(ValueError):
        S.page(df, "", 1, 500)
    assert S.did_you_mean(df, "aaAb x").first().message == "aaAa x" and S.did_you_mean(df, "zzzzzzzzzzzzzzzz").collect() == []
    assert rows(S.fuzzy_lines(df, "ab", 1)) == {(1, "b", 1), (2, "aa", 1)}
    assert len(S.suggest(df, "", 1).collect()) == 1


def test_scans_match_loops(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5 - 2 if i % 11 else None) for i in range(200)], "id long, v long")
    run, inc, exc = 0, {}, {}
    for i in range(200):
        v = ((i * 7) % 5 - 2) if i % 11 else 0
        exc[i] = run
        run += v
        inc[i] = run
    assert {r.id: r.scan for r in P.scan(df, ["id"], "v").collect()} == inc and {r.id: r.scan for r in P.scan(df, ["id"], "v", False).collect()} == exc
    assert P.reduce_column(df, "count", F.col("v")).first().result == sum(((i * 7) % 5 - 2) > 0 for i in range(200) if i % 11)
    big = spark.createDataFrame([(2**63 - 1,), (1,)], "v long")
    assert P.reduce_column(big, "SUM", F.col("v")).first().result is None


def test_bursts_and_last_n(logs):
    df = logs([{"service": "s", "ts": t, "level": "ERROR" if t >= 20 else "INFO"} for t in range(25) for _ in range(5 if t >= 24 else 1)])
    got = {r.bucket: (r.errors, r.burst) for r in B.burst_readings(df, 1000).collect()}
    assert got[24] == (5, True) and got[19] == (0, False)
    r = B.last_n(df, 7).first()
    assert (r.events, r.errors) == (7, 7)
    assert B.replay_batches(df, 10).orderBy("batch").first().events == 10


def test_small_functions(spark):
    df = spark.createDataFrame([("aaaa", 3)], "t string, k long")
    r = df.select(
        L.overlapping_count(F.col("t"), "aa"), L.match_positions(F.col("t"), "aa"), L.polynomial_hash(F.col("t")), L.universal_hash(F.col("k"), 2**60, 2**59, 64),
        L.overlapping_count(F.lit(r"x\Ey\E"), r"\E"), L.snippet(F.lit("x" * 100 + "HIT" + "y" * 100), "hit"),
    ).first()
    h = 0
    for _ in "aaaa":
        h = (h * 911382323 + 97) % 1_000_000_007
    assert list(r)[:5] == [3, [0, 1, 2], h, (2**60 * 3 + 2**59) % (2**61 - 1) % 64, 2] and r[5] == "…" + "x" * 30 + "HIT" + "y" * 40 + "…"
