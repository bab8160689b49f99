import random

from cindertrail.llm import mixture as M
from cindertrail.llm.tokens import encoding, token_count

DOC = "doc_id long, source string, text string"


def mixed(spark, docs, targets, **kw):
    chosen, plan = M.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **kw)
    return chosen.collect(), {r.source: r for r in M.shares(chosen, plan).collect()}, {r.source for r in M.short_sources(M.shares(chosen, plan)).collect()}


def corpus(n=600, seed=8):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "A ", "b", "b", "b", "c"]), "word " * rng.randrange(1, 60)) for i in range(n)]


def test_shares_are_reached_within_the_landing_error(spark):
    chosen, got, short = mixed(spark, corpus(), [("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, 9), ("gone", 0.0, 1)])
    for s in "abc":
        assert abs(got[s].mix_tokens - got[s].target_tokens) <= 60
        assert abs(got[s].reached_share - got[s].target_share) < 0.01
    assert short == set() and all(1 <= r.copies <= 9 for r in chosen)


def test_cap_and_missing_source(spark):
    chosen, got, short = mixed(spark, corpus(), [("a", 0.05, 1), ("c", 0.85, 2), ("gone", 0.1, 4)])
    assert short == {"c", "gone"} and got["c"].mix_tokens == 2 * got["c"].size_tokens and got["gone"].mix_tokens == 0
    assert all(r.copies == 2 for r in chosen if r.source == "c")


def test_odd_rows(spark):
    docs = [(1, None, "x y"), (2, "a", None), (3, "a", ""), (4, "a", "long " * 30_000)]
    chosen, got, short = mixed(spark, docs, [("a", 0.5, 1), (None, 0.5, 1)])
    assert set(got) == {"a"} and sum(r.copies for r in chosen) <= 3
    assert mixed(spark, [], [("a", 1.0, 1)])[2] == set()


def test_flight_keeps_totals_and_probabilities():
    rng = random.Random(9)
    tokens = [rng.randrange(1, 500) for _ in range(400)]
    hits = [0] * 400
    for seed in range(60):
        f = M.Flight(str(seed))
        done = [u for i, t in enumerate(tokens) for u in f.feed([0.3, t, i])]
        rest = f.rest()
        assert len(rest) <= 2 and len(done) + len(rest) == 400
        assert abs(sum(u[0] * u[1] for u in done + rest) - 0.3 * sum(tokens)) < 1e-3
        assert abs(sum(u[0] for u in done + rest) - 120) < 1e-6
        for u in done:
            hits[u[2]] += u[0] == 1.0
    assert abs(sum(hits) / 60 - 120) < 2 and max(hits) < 40


def test_landing_takes_the_nearest():
    assert [u[0] for u in M.land([[0.5, 10, 0], [0.5, 12, 1]])] in ([1.0, 0.0], [0.0, 1.0])
    assert M.land([]) == []


def test_token_counts_match_the_tokenizer(spark):
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    texts = ["hello world", "", None, "Größe <|endoftext|> 漢字", "a" * 50_000, "some words \n" * 30_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t")).collect()]
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def test_choice_hangs_on_the_records_alone(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 40)  # several buckets a source
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, 9)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([*corpus(), (9001, "a", ""), (9002, "b", None)], DOC)
    one, other = (sorted(map(tuple, M.mix(docs.repartition(n), targets)[0].collect())) for n in (1, 7))
    assert one == other and len(one) > 100 and all(r[2] > 0 for r in one)
    got = {r.source: r for r in M.shares(*M.mix(docs.repartition(3), targets)).collect()}
    assert all(abs(got[s].mix_tokens - got[s].target_tokens) <= 60 for s in "abc")
