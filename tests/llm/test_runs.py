import random
import re

from pyspark.sql import functions as F

from cindertrail.llm.runs import canonical_message, collapse_runs


def canon(m):
    if m is None:
        return None
    m = re.sub(r"[\s.!]+$", "", m.lower())
    return " ".join("#" if re.search(r"\d", w) else w for w in m.split())


def brute(rows):
    seen, by = {}, {}
    for r in rows:
        key = (r["service"], r["ts"], r["message"])
        if key not in seen:
            seen[key] = r
            if r["service"] is not None:
                by.setdefault(r["service"], []).append(r)
    out = set()
    for s, rs in by.items():
        rs.sort(key=lambda r: (r["ts"], r["id"]))
        i = 0
        while i < len(rs):
            j = i
            while j + 1 < len(rs) and canon(rs[j + 1]["message"]) == canon(rs[i]["message"]):
                j += 1
            out.add((s, rs[i]["id"], rs[j]["id"], j - i + 1, (rs[j]["ts"] - rs[i]["ts"]) * 10**6))
            i = j + 1
    return out


def got(df, **kw):
    return {(r.service, r.first_id, r.last_id, r.events, r.duration_us) for r in collapse_runs(df, **kw).collect()}


def test_random_rows_match_brute_force(spark, logs):
    rng = random.Random(6)
    texts = ["a 1 b", "A  22 b.", "c", "c!", None, "", "x9"]
    rows = [{"id": i, "service": rng.choice(["s", "s", "s", "t", None]), "ts": rng.randrange(60), "message": rng.choice(texts)} for i in range(300)]
    rows += [{**rows[i], "id": 300 + i} for i in range(0, 300, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, many edges
    try:
        df = logs(rows).withColumn("entity", F.lit(1)).withColumn("part", F.lit("x"))
        assert got(df) == brute(rows)
        assert got(df, min_events=3) == {r for r in brute(rows) if r[3] >= 3}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_run_over_all_ranges(logs):
    rows = [{"service": "s", "ts": i, "message": f"hello {i}"} for i in range(500)]
    assert got(logs(rows)) == {("s", 0, 499, 500, 499_000_000)}


def test_empty_and_long(logs):
    assert got(logs([])) == set()
    assert len(got(logs([{"service": "s", "ts": 1, "message": "w " * 50_000}]))) == 1


def test_canonical(spark):
    values = ["Reply  sent with 583 bytes.", "reply sent with x7 bytes !!", "reply sent with bytes", "ok.", "OK"]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "m string").select(canonical_message(F.col("m"))).collect()]
    assert out[0] == out[1] != out[2] and out[3] == out[4]
