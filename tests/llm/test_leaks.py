import random
import re
from collections import Counter

from cindertrail.llm.leaks import UNITS, item_classes, leaks, variants

ITEM = "When the alpha relay drops its beta lease during a gamma handover, which delta counter should the operator read before the epsilon queue is drained after 44 beats?"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n=13):
    grams = lambda t: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, **kw):
    return {(r.doc_id, r.item_id) for r in leaks(*frames(spark, docs, items), **kw).collect()}


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" if i % 3 else f"word{'abcdefghij'[i % 10]}" for i in range(12)]
    item = lambda: " ".join(rng.choice(vocab) for _ in range(30))
    items = [(i, item()) for i in range(12)]
    docs = []
    for d in range(60):
        text = item()
        if d % 2:
            w = rng.choice(items)[1].split()
            k = rng.randrange(10, 16)
            at = rng.randrange(len(w) - k)
            text += " -- " + ", ".join(w[at : at + k]).upper() + ". " + item()
        docs.append((d, text))
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, name_max_items=0) == brute(docs, items)


def test_twelve_words_are_too_few_and_separators_do_not_matter(spark):
    w = words(ITEM)
    docs = [(1, " ".join(w[:12])), (2, "_".join(w[3:16]).upper()), (3, ""), (4, None), (5, " ".join(w[:12] + ["x"] + w[13:24]))]
    assert found(spark, docs, [(9, ITEM), (8, None), (7, "short")]) == {(2, 9)}


def test_repeats_count_places(spark):
    d, i = frames(spark, [(1, f"{ITEM} and {ITEM}")], [(9, ITEM), (9, ITEM)])
    (r,) = leaks(d, i).collect()
    assert r.windows == 2 * (len(words(ITEM)) - 12) and r.first_word == 0


NAMES = ("alpha", "beta", "gamma", "delta", "epsilon")


def family(n):
    return [(i, re.sub("|".join(NAMES), lambda m, i=i: m.group() + "abcdefghijkl"[i], ITEM)) for i in range(n)]


def linked(spark, docs, items):
    return {r.doc_id: (r.class_id, r.windows, r.links, r.exact) for r in variants(*frames(spark, docs, items)).collect()}


def test_reparameterised_questions(spark):
    items, n = family(12), len(words(ITEM)) - 12
    other = ITEM.replace("alpha", "omicron").replace("gamma", "sigma").replace("44", "7")
    mixed = other.replace("sigma handover", "omicron handover")  # two slots, one filler: not one to one
    got = linked(spark, [(1, other), (2, "x " * 40), (3, mixed), (4, items[5][1])], items)
    assert got == {1: (0, n, 12, 0), 4: (0, n, 12, 1)}
    assert {(r.item_id, r.class_id) for r in item_classes(frames(spark, [], items)[1]).collect()} == {(i, 0) for i in range(12)}


def test_reparameterised_passages_of_one_and_two_windows(spark):
    items = family(12)
    w = words(ITEM.replace("alpha", "omicron").replace("gamma", "sigma"))
    twice = ["omicron" if x == "sigma" else x for x in w]  # two slots, one filler
    docs = [(1, " ".join(w[:13])), (2, " ".join(w[2:16])), (3, " ".join(w[:12])), (4, " ".join(twice[:13])), (5, " ".join(words(items[0][1])[:13]))]
    assert linked(spark, docs, items) == {1: (0, 1, 12, 0), 2: (0, 2, 12, 0), 5: (0, 1, 12, 1)}


def test_items_alike_in_their_slots_are_counted_together(spark):
    """Two items use one name twice, the others two names: a document links to its own kind only."""
    items = family(12)
    doubled = [(20 + i, t.replace("beta", "alpha")) for i, t in items[:2]]
    own = ITEM.replace("alpha", "omicron").replace("beta", "sigma")
    docs = [(1, own), (2, own.replace("sigma", "omicron"))]
    got = linked(spark, docs, items + doubled)
    assert {d: (c, links) for d, (c, _, links, _) in got.items()} == {1: (0, 12), 2: (0, 2)}


def test_planted_variants_are_found(spark, sf):
    """Recall and precision over every family of the test items, with new names and numbers put in."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    plain = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    classes = {r.item_id: r.class_id for r in item_classes(frames(spark, [], items)[1]).collect()}
    sizes = Counter(classes.values())
    used = Counter(w for _, t in items for w in set(words(t)))
    rng, docs, truth = random.Random(3), [], {}
    for n, (i, t) in enumerate(x for x in items if sizes[classes.get(x[0])] > 1):
        new = {}
        fresh = lambda w: new.setdefault(w, str(rng.randrange(10**6)) if re.search(r"\d", w) else "q" + "".join(rng.choice("bcdfgklm") for _ in range(9)))
        filled = " ".join(fresh(w) if re.search(r"\d", w) or used[w] <= 8 else w for w in words(t))
        docs.append((1_000_000 + n, f"{rng.choice(plain)[1]} {filled} {rng.choice(plain)[1]}"))
        truth[1_000_000 + n] = classes[i]
    rows = variants(*frames(spark, docs, items)).collect()
    got = {(r.doc_id, r.class_id) for r in rows if r.share == 1}
    hit = sum(p in got for p in truth.items())
    assert len(truth) > 20 and hit / len(truth) >= 0.9, (hit, len(truth))
    # Some questions are parts of others: by brute force, every question that stands in a text with other words put in.
    slot = lambda w: "<num>" if re.search(r"\d", w) else "<unit>" if w in UNITS else w if used[w] > 8 else "<name>"
    by_class = {}
    for i, t in items:
        by_class.setdefault(classes.get(i), []).append(words(t))

    def stands(w, c):
        for q in by_class[c]:
            for at in range(len(w) - len(q) + 1):
                pairs = set(zip(w[at : at + len(q)], q))
                if all(slot(x) == slot(y) for x, y in pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
                    return True
        return False

    real = {(d, c) for d, t in docs for c in by_class if c is not None and stands(words(t), c)}
    print(f"planted {len(truth)}, found {hit}; questions in the texts {len(real)}, reported {len(got)}, right {len(got & real)}")
    assert len(got & real) >= 0.9 * len(real) and len(got & real) >= 0.9 * len(got)


def test_empty(spark):
    assert found(spark, [], [(1, ITEM)]) == set() and found(spark, [(1, ITEM)], []) == set()
