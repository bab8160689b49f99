from pyspark.sql import functions as F

from cindertrail.operators import frames as R
from cindertrail.sources import simulation

SCHEMA = "session string, tick int, intensity double, id long, service string, level string, response_ms long, message string"


def session(spark, ticks, key="s"):
    """Events from lists per tick: (level, service, response_ms, message)."""
    rows = [(key, t, 0.0, t * 1000 + i, s, lvl, ms, m) for t, events in enumerate(ticks) for i, (lvl, s, ms, m) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def test_open_bucket_is_judged_tick_by_tick(spark):
    calm, bad = [("INFO", "a", 10, "ok")], [("ERROR", "a", 10, "lost")] * 2
    got = {r.tick: (r.bucket, r.bucket_errors, r.burst) for r in R.frames(session(spark, [calm] * 4 + [bad] * 3), ("lost",), "CRITICAL").collect()}
    assert got[3] == (0, 0, False) and got[4] == (1, 2, False) and got[5] == (1, 4, True) and got[6] == (1, 6, True)


def test_baselines_learn_from_quiet_ticks(spark):
    ticks = [[("INFO", "a", 100, None)] * n for n in (2, 2, 2, 4, 40)]
    e = session(spark, ticks)
    base = {r.tick: (round(r.base_eps, 3), r.base_p95) for r in R.baselines(R.tick_counters(e), R.tick_p95(e)).collect()}
    assert base == {0: (8.0, 200), 1: (8.0, 200), 2: (8.0, 200), 3: (9.2, 200), 4: (31.82, 200)}


def test_signatures_of_the_last_events(spark):
    ticks = [[("ERROR", "a", 1, "pool drained, pool drained")]] + [[("INFO", "a", 1, "ok")] * 3] * 3
    got = {(r.tick, r.signature): r.hits for r in R.signature_counts(session(spark, ticks), ("pool drained", "no such"), last=5).collect()}
    assert got == {(0, "pool drained"): 2, (1, "pool drained"): 2}


def test_health_lists_silent_services(spark):
    nodes = spark.createDataFrame([("a", "app"), ("z", "data")], "service string, tier string")
    e = session(spark, [[("ERROR", "a", None, None), ("INFO", "a", -5, "x"), ("INFO", "b", 50_000, "x")]])
    got = {r.service: (r.events, r.errors, r.avg_ms, r.state, r.load) for r in R.health(e, nodes).collect()}
    assert got == {"a": (2, 1, 0, "critical", 1.0), "z": (0, 0, 0, "healthy", 0.0)}
    assert R.health(session(spark, []), nodes).collect() == [] and R.frames(session(spark, []), ("x",), "MAJOR").collect() == []


def test_sessions_run_side_by_side(spark):
    one = session(spark, [[("ERROR", "a", 900, "lost")] * 5] * 3)
    two = session(spark, [[("INFO", "a", 10, "ok")]] * 9, "t")
    cols = ["tick", "generated", "errors", "p95_ms", "signature_hits"]
    alone = {tuple(r) for r in R.frames(one, ("lost",), "MAJOR").select(*cols).collect()}
    both = {tuple(r) for r in R.frames(one.unionByName(two), ("lost",), "MAJOR").where("session = 's'").select(*cols).collect()}
    assert alone == both and len(alone) == 3


def test_scenario_events_from_a_stream_of_ticks(spark, tmp_path):
    fleet = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "service string, base_share double")
    spark.dataSource.register(simulation.TickSource)
    ticks = spark.readStream.format("ticks").option("ticks", 30).option("perBatch", 10).load()
    e = simulation.scenario_events(ticks, "cache-failure", fleet)
    q = e.writeStream.format("memory").queryName("scenario_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = simulation.simulate(spark, "cache-failure", fleet, ticks=30)
    got = spark.table("scenario_out")
    assert got.count() == want.count() > 300 and got.exceptAll(want).isEmpty()
    assert got.agg(F.max("tick")).first()[0] == 29
