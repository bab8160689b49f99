import math
import random

from cindertrail.llm import percentiles as P

PROBS = {"p50": 0.5, "p95": 0.95, "p100": 1.0}


def brute(rows, p):
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    return {g: sorted(v)[max(1, -(-int(p * 1000) * len(v) // 1000)) - 1] for g, v in by.items()}


def exact(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, v long")
    return {r.g: r for r in P.percentiles(P.frequencies(df, ("g",), "v", **kw), ("g",), PROBS).collect()}


def test_matches_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 5, rng.randrange(1000)])) for _ in range(3000)] + [("one", 4)]
    got = exact(spark, rows)
    for name, p in PROBS.items():
        assert {g: r[name] for g, r in got.items()} == brute(rows, p)
    assert got["one"].n == 1


def test_merging_parts_equals_the_whole(spark):
    rng = random.Random(4)
    parts = [spark.createDataFrame([("g", rng.randrange(50)) for _ in range(n)], "g string, v long") for n in (10, 200, 1)]
    union = parts[0].union(parts[1]).union(parts[2])
    one = P.percentiles(P.frequencies(union, ("g",), "v"), ("g",), PROBS).collect()
    many = P.percentiles(P.merge_frequencies(*[P.frequencies(x, ("g",), "v") for x in parts]), ("g",), PROBS).collect()
    assert one == many


def test_bounded_error(spark):
    rng = random.Random(5)
    rows = [("g", int(math.exp(rng.uniform(0, 12)))) for _ in range(4000)]
    got, want = exact(spark, rows, relative_error=0.02)["g"], brute(rows, 0.95)["g"]
    assert abs(got.p95 - want) <= 0.021 * want


def test_rank_is_not_rounded_up_by_floats(spark):
    assert exact(spark, [("g", i) for i in range(1, 181)])["g"].p95 == 171


def test_empty(spark):
    assert exact(spark, []) == {}
