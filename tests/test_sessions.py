import random

from pyspark.sql import functions as F

from cindertrail.operators.sessions import GAP_US, SessionTimers, session_bounds, sessionize
from cindertrail.streaming.sessions import merge_intervals, stream_sessions


def brute(rows, gap=1800):
    by = {}
    for u, t in rows:
        key = (u or "").strip().lower()
        if key and key != "-":
            by.setdefault(key, []).append(t)
    out = set()
    for u, ts in by.items():
        ts.sort()
        start = last = ts[0]
        for t in ts[1:]:
            if t - last > gap:
                out.add((u, start * 10**6, last * 10**6))
                start = t
            last = t
        out.add((u, start * 10**6, last * 10**6))
    return out


def bounds(df):
    return {(r.user_id, r.start_us, r.end_us) for r in session_bounds(df).collect()}


def test_random_users_match_brute_force(logs):
    rng = random.Random(1)
    rows = [(rng.choice(["a", " A", "b ", "-", None, "  ", "c"]), rng.randrange(0, 100_000)) for _ in range(400)]
    assert bounds(logs([{"user_id": u, "ts": t} for u, t in rows])) == brute(rows)


def test_gap_is_inclusive_and_ties_share_a_session(logs):
    df = logs([{"user_id": "u", "ts": t} for t in (0, 0, 1800, 3601)])
    assert bounds(df) == {("u", 0, 1_800_000_000), ("u", 3_601_000_000, 3_601_000_000)}


def test_empty_null_and_clashing_columns(logs):
    assert bounds(logs([])) == set()
    df = logs([{"user_id": None, "ts": 5}, {"user_id": "x", "ts": None}, {"user_id": "x" * 50_000, "ts": 5}])
    df = df.withColumn("key", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("ts_us", F.lit(3))
    assert {len(u) for u, _, _ in bounds(df)} == {50_000}


def test_counts_without_copies(logs):
    rows = [{"user_id": "u", "ts": 10, "request_id": "r1", "message": "m"}] * 3 + [
        {"user_id": "U ", "ts": 20, "request_id": "r1"},
        {"user_id": "u", "ts": 30, "request_id": None},
        {"user_id": "u", "ts": 40, "request_id": "r2"},
        {"user_id": "u", "ts": 9000, "request_id": "r1"},
    ]
    got = {(r.start_us, r.events, r.requests, r.duration_us) for r in sessionize(logs(rows)).collect()}
    assert got == {(10_000_000, 4, 2, 30_000_000), (9_000_000_000, 1, 1, 0)}


def test_timers_fire_in_order():
    t = SessionTimers(10)
    fired = [t.update("a", 0, 5, 2), t.update("a", 15, 15, 1), t.update("a", 26, 26, 1), t.update("b", 0, 0, 1), t.expire(), t.expire()]
    assert fired == [None, None, ("a", 0, 15, 3), ("a", 26, 26, 1), ("b", 0, 0, 1), None]


def test_merge_intervals_any_order():
    assert merge_intervals([(20, 25, 1), (0, 1, 2), (11, 12, 1)], 10) == [(0, 25, 4)]
    assert merge_intervals([(20, 25, 1), (0, 1, 2)], 10) == [(0, 1, 2), (20, 25, 1)]


def test_stream_equals_batch(spark, logs, tmp_path):
    rng = random.Random(2)
    rows = [{"user_id": rng.choice("abc"), "ts": rng.randrange(0, 40_000)} for _ in range(120)]
    for i in range(3):
        logs(rows[i * 40 : i * 40 + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = bounds(logs(rows))
    logs([{"user_id": "z", "ts": 400_000}]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    stream = spark.readStream.schema(logs([]).schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = (
        stream_sessions(stream, lateness="1 day")
        .writeStream.format("memory").queryName("sessions_out").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = {(r.user_id, r.start_us, r.end_us) for r in spark.table("sessions_out").collect()}
    assert got == want
    assert GAP_US == 1_800_000_000
