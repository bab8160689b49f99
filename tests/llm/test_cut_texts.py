import random
import re
from collections import Counter

import numpy as np

from cindertrail.llm import cut_texts as C

DOC = "doc_id long, source string, text string"
SENTENCES = [
    "The {s} service stopped answering writes for {n} minutes.", "Nobody changed {s} that day, so we looked at the cache instead.",
    "There were {n} retries against {s}, most of them from the mailer.", "Keep an eye on heap use until {n}:30.",
    "Restarting {s} helped, but only until the next nightly run.", "We now keep letters for {n} days and trim them at night.",
]


def text(rng, n):
    return " ".join(rng.choice(SENTENCES).format(s=rng.choice(["billing", "basket", "identity"]), n=rng.randrange(10, 99)) for _ in range(n))


def corpus(seed=10, n=1500, limit=300):
    """Documents with their truth: cut at the limit of source a, in transfer, with a note behind, or whole."""
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        source = rng.choice(["a", "a", "b", " B"])
        t = text(rng, rng.randrange(2, 9))
        how = rng.random()
        if source == "a" and len(t) > limit:
            rest, t = t[limit:], t[:limit]
            if re.match(r"[\d:]*\.", rest):  # all but the full stop is there: nobody can tell
                continue
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif how < 0.05:
            at = rng.randrange(40, len(t) - 3)
            if t[at - 1] not in ". " and t[at] != ".":
                cut.add(i)
                t = t[:at] + rng.choice(["", "", "...", " [truncated]"])
        elif how < 0.06:
            t += " Restarting basket helped,"
            cut.add(i)
        elif how < 0.15:
            t = t[:-1]
        elif how < 0.3:
            t += rng.choice(["\nTo be continued...", "\n\nRegards,\nshift lead", "\n(no further action needed)", "\n- rotate the key\n- close the ticket"])
        docs.append((i, source, t))
    return docs, cut


def test_planted_cuts_are_found(spark):
    docs, cut = corpus()
    got = {r.doc_id for r in C.cut_texts(spark.createDataFrame(docs, DOC)).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got & cut) >= 0.97 * len(got)


def test_limits_and_posterior(spark):
    docs, _ = corpus()
    limits = C.length_limits(spark.createDataFrame(docs, DOC)).collect()
    assert [(r.source, r.length) for r in limits] == [("a", 300)] and limits[0].censored > 0.9


def test_fit_recovers_a_censored_lognormal():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(6.0, 0.5, 20_000)).astype(int)
    cut = int(np.quantile(x, 0.7))
    values, counts = np.unique(np.minimum(x, cut), return_counts=True)
    mu, sd = C._censored_lognormal(np.log(values), counts, values == cut)
    assert abs(mu - 6.0) < 0.03 and abs(sd - 0.5) < 0.03


def test_counts_by_brute_force(spark):
    """Counts of all orders, of what follows a context and of longer words there, with and without the bitmap."""
    rng = random.Random(5)
    vocab = ["a", "an", "ant", "anthem", "be", "bee", "been", "7", "x"]
    docs = [(i, "a", " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30))) + rng.choice(["", ".", "\n"])) for i in range(60)]
    codes, want = C.Codes(), Counter()
    for _, _, t in docs:
        flat = C.LEAD + [codes[x] for x in C.TOKEN.findall(t)]
        words = [C.plain(x) for x in C.TOKEN.findall(t) if x not in "\n.!?"]
        _, ends, context, grams = C.grams_of(flat)
        for k in C.ORDERS:
            for g, e in zip(C.signed(grams[k]).tolist(), ends):
                want[k, g, "n"] += 1
                want[k, g, "ends"] += int(e)
        for i, (c, w) in enumerate(zip(context, words)):
            want[C.FOLLOWING, int(C.signed(context)[i]), "n"] += 1
            for j in range(1, len(w)):
                with np.errstate(over="ignore"):
                    want[C.LONGER, int(C.signed(C.mix(np.array([c]), np.array([codes[w[:j]]], dtype=np.uint64)))[0]), "n"] += 1
    df = spark.createDataFrame(docs, DOC)
    got = {(r.k, r.gram, c): r[c] for r in C.count_grams(df, flush=100).collect() for c in ("n", "ends") if r[c]}
    assert got == {k: v for k, v in want.items() if v}
    endings = C.open_endings(df)
    some = {(r.k, r.gram): r.n for r in C.count_grams(df, asked=C.asked_of(endings)).collect()}
    assert all(want[k, g, "n"] == n for (k, g), n in some.items()) and len(some) < len({x[:2] for x in want})
    for r in endings.collect():
        assert all((k, r[f"g{k}"]) in some for k in C.ORDERS) and (C.FOLLOWING, r.context) in some


def test_marks_of_any_length():
    codes = C.Codes()
    words = "we looked at the cache inste"
    for mark in ("...", " …", f" [{'x ' * 60}cut]", f" ({'y' * 90})", f"<{'a b ' * 40}>", "<br", f"-- {'more ' * 30}--", " [see. more! text]"):
        got = {t[0]: t[6] for t in C.tails(words + mark, codes)}
        assert got.get("mark") == "inste", mark
        assert {t[0]: t[6] for t in C.tails("Long text here. " * 100 + words + mark, codes)}["mark"] == "inste"
    assert [t[0] for t in C.tails("All is well.", codes)] == [] and "mark" not in {t[0] for t in C.tails("a (b) c", codes)}


def test_copies_do_not_vouch_for_each_other(spark):
    docs, _ = corpus(n=600)
    broken = docs[0][2][:60] + " and the mailer began to dro"
    docs = docs[:500] + [(9000 + i, "b", broken) for i in range(40)]
    got = {r.doc_id for r in C.cut_texts(spark.createDataFrame(docs, DOC)).collect()}
    assert set(range(9000, 9040)) <= got


def test_odd_texts(spark):
    docs = [(1, None, None), (2, "a", ""), (3, "a", "  \n "), (4, None, "?!"), (5, "a", "word " * 40_000 + "."), (6, "a", "。" * 10)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as gram", "'x' as place")
    assert C.cut_texts(df).collect() == []
    assert {r.source: (r.texts, r.cut) for r in C.cut_report(df, C.cut_texts(df)).collect()} == {None: (2, 0), "a": (4, 0)}
    assert C.cut_texts(spark.createDataFrame([], DOC)).collect() == []


def test_tail_context_is_the_same_from_behind():
    rng = random.Random(11)
    long = text(rng, 400) + " the end is brok"
    codes = C.Codes()
    (tail,) = C.tails(long, codes)
    flat = C.LEAD + [codes[t] for t in C.TOKEN.findall(long)]
    _, _, context, grams = C.grams_of(flat)
    assert tail[1:5] == tuple(int(C.signed(grams[k])[-1]) for k in C.ORDERS) and tail[5] == int(C.signed(context)[-1])
