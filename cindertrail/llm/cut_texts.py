"""Text cut off by field limits or in transfer.

Two kinds of evidence meet in one posterior. The lengths of each source are fitted by a
right-censored log-normal (maximum likelihood by EM): lengths at which far more texts end
than the density allows are candidate limits, their texts enter the fit as censored, and
what exceeds the fitted density is the posterior that a text of that length was censored.
The ending is judged against the corpus: the last words of a text, in contexts of up to five
words, either end sentences and lines elsewhere or always go on, and a last word that never
follows its two predecessors while longer words with that beginning do is a broken word.
Counts leave the text's own ending, and that of equal texts, out. What was appended on the same
line after a cut (dots, a bracketed note, a piece of markup) is set aside and the words before it
are judged.

Endings are read first; the counts are taken over every word of every text, but only those an
ending asks for leave a task. The tasks know them by a bitmap of BITS bits, whatever the number
of endings: what it lets through by mistake is never joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import folded
from cindertrail.session import materialise

try:
    from xxhash import xxh3_64_intdigest as _hash
except ImportError:
    from hashlib import blake2b

    def _hash(b: bytes) -> int:
        return int.from_bytes(blake2b(b, digest_size=8).digest(), "little")


#: A word, the end of a line, or a sign that closes a sentence.
TOKEN = re.compile(r"\d[\w.:,-]*\d|[^\W_]+(?:['’\-][^\W_]+)*|\n|[.!?](?=[\s\"'”’)\]]|$)")
CLOSED = re.compile(r"[\"'”’)\]]*\s?[.!?][\"'”’)\]]*\s*$")
DOTS = re.compile(r"\.\.|…")
MARK = re.compile(r"\s*(?:\[[^\[\]\n]+\]|\([^()\n]+\)|<[^<>\n]*>?|\.{2,}|…|-{2,}[^\n]+?-{2,})\s*$")
#: The signs a mark may begin with, and an ending that is closed for sure.
OPENERS = ("[", "(", "<", "--", "..", "…")
SHUT = re.compile(r"[^\W_][.!?]\s*$")
DIGIT = re.compile(r"\d")
PAD, LINE, STOP = 0, 1, 2  # before the text, start of a line, closing sign
ORDERS = (1, 2, 3, 5)
#: Kinds of counts beside the orders: any word after a context, and longer words with a word's beginning.
FOLLOWING, LONGER = 4, 6
BITS = 26
#: Share of texts expected to be cut away from any limit; a prior, not a cap.
TRANSFER_PRIOR = 0.08
#: What a length at a limit can say at most: texts end there by chance as well.
LIMIT_TRUST = 0.9


class Codes(dict):
    """Tokens to 64-bit codes; numbers are one word, all the same. Emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if token == "\n":
            code = LINE
        elif token in ".!?":
            code = STOP
        else:
            word = plain(token)
            code = max(16, _hash(word.encode("utf-8", "surrogatepass")))
        if len(self) > 500_000:
            self.clear()
        self[token] = code
        return code


def plain(token: str) -> str:
    return "0" if DIGIT.search(token) else token.lower()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)


def grams_of(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For the codes of texts, each led by PADs and a LINE: (places of words in ``codes``,
    end flags, context hashes, gram hashes by order).

    A word ends a sentence or line if a closing sign, a line end or nothing follows it.
    """
    arr = np.array(codes, dtype=np.uint64)
    word = np.flatnonzero(arr > STOP)
    ends = np.ones(len(word), dtype=bool)
    ends[:-1] = np.diff(word) > 1
    keep = arr != STOP
    seq_at = np.flatnonzero(keep)
    seq = arr[seq_at]
    single = np.ones(len(seq), dtype=bool)
    single[1:] = ~((seq[1:] == LINE) & (seq[:-1] == LINE))
    seq, seq_at = seq[single], seq_at[single]
    at = np.flatnonzero(seq > STOP)
    back = [seq[np.maximum(at - i, 0)] for i in range(5)]
    with np.errstate(over="ignore"):
        context = mix(back[2], back[1])
        grams = {1: back[0], 2: mix(back[1], back[0]), 3: mix(context, back[0]), 5: mix(mix(mix(mix(back[4], back[3]), back[2]), back[1]), back[0])}
    return word, ends, context, grams


LEAD = [PAD] * 5 + [LINE]


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def last_tokens(text: str, need: int = 9) -> list[tuple[str, int, int]]:
    """The last tokens of a text with their places, read from behind; led by None if it starts earlier."""
    span = 400
    while True:
        start = max(0, len(text) - span)
        found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start)]
        if start == 0:
            return found
        if sum(t[0] != "\n" and t[0] not in ".!?" for t in found) > need:
            return found[1:]
        span *= 4


def mark_of(text: str) -> re.Match | None:
    """The mark at the end of a text, of any length but on its last line."""
    line = text.rfind("\n", 0, len(text.rstrip())) + 1
    if not any(o in text[line:] for o in OPENERS):
        return None
    last = text.rstrip()[-1:]
    if last in "])" or last == ">":
        at = text.rfind({"]": "[", ")": "(", ">": "<"}[last], line)
    elif last == "-":
        body = text.rstrip().rstrip("-")
        at = body.rfind("--", line)
        while at > line and text[at - 1] == "-":
            at -= 1
    else:
        at = max(len(text.rstrip().rstrip(".")), text.rfind("<", line)) if last == "." else text.rfind("…" if last == "…" else "<", line)
    if at < 0:
        return None
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return MARK.match(text, at)


def open_tails(texts: list, codes: Codes) -> list[tuple]:
    """Open endings to judge: (text, place, gram hashes of ORDERS, context hash, word, own end count)."""
    flat: list[int] = []
    asks: list[tuple[int, str, int, str]] = []
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text or SHUT.search(text, max(0, len(text) - 40)):
            continue
        found = last_tokens(text)
        words = [j for j, t in enumerate(found) if t[0] != "\n" and t[0] not in ".!?"]
        if not words:
            continue
        asked = []
        gap = text[found[words[-1]][2] :]
        if not (CLOSED.match(gap) and not DOTS.search(gap)):
            asked.append(("hanging" if gap.rstrip()[-1:] in (",", ";") else "end", words[-1]))
        if m := mark_of(text):
            before = [j for j in words if found[j][2] <= m.start()]
            if not before and found[0][1] > 0:  # the mark is longer than what was read
                found = [(x.group(), x.start(), x.end()) for x in TOKEN.finditer(text)]
                words = [j for j, t in enumerate(found) if t[0] != "\n" and t[0] not in ".!?"]
                before = [j for j in words if found[j][2] <= m.start()]
                asked = [(place, words[-1]) for place, _ in asked]
            if before and not re.search(r"[.!?]", text[found[before[-1]][2] : m.start()]):
                asked.append(("mark", before[-1]))
        if not asked:
            continue
        flat += LEAD if found[0][1] == 0 or len(text) <= 400 else [PAD]
        asks += [(i, place, len(flat) + j, plain(found[j][0])) for place, j in asked]
        flat += [codes[t[0]] for t in found]
    if not asks:
        return []
    places, ends, context, grams = grams_of(flat)
    at = np.searchsorted(places, [a[2] for a in asks])
    hashes = zip(*[signed(h)[at].tolist() for h in (*(grams[k] for k in ORDERS), context)])
    return [(i, place, *h, word, int(e)) for (i, place, _, word), h, e in zip(asks, hashes, ends[at])]


def tails(text: str, codes: Codes) -> list[tuple]:
    return [t[1:] for t in open_tails([text], codes)]


class Asked:
    """Which hashes are asked for: a bitmap over their first BITS bits; None lets everything through."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), dtype=bool)
        at = keys >> np.uint64(64 - BITS)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def asked_of(endings: DataFrame) -> np.ndarray:
    """The bitmap of all hashes the endings ask for: 2^BITS bits, read to the driver as at most 2^(BITS - 6) words."""
    keys = endings.select(F.explode(F.array(*[f"g{k}" for k in ORDERS], "context")).alias("key"))
    at = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


class Beginnings(dict):
    """Words to the codes of their proper beginnings. Emptied when it grows large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = () if word == "0" else tuple(max(16, _hash(word[:i].encode("utf-8", "surrogatepass"))) for i in range(1, len(word)))
        return found


def count_grams(documents: DataFrame, text: str = "text", flush: int = 1_000_000, asked: np.ndarray | None = None) -> DataFrame:
    """k, gram, n, ends over the whole corpus; tasks add up before the shuffle.

    Beside the ORDERS: how often any word follows a context (FOLLOWING, by context), and how often
    a longer word that begins with a word follows its context (LONGER, by the gram of order 3).
    """
    sent = documents.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, flat, tokens, wanted, starts = Codes(), [], [], Asked(sent.value), Beginnings()

        def summed(k: int, keys: np.ndarray, n: np.ndarray | None = None, ends: np.ndarray | None = None) -> pd.DataFrame:
            keys, inverse = np.unique(keys, return_inverse=True)
            n = np.bincount(inverse, weights=n, minlength=len(keys))
            ends = np.zeros(len(keys)) if ends is None else np.bincount(inverse, weights=ends, minlength=len(keys))
            return pd.DataFrame({"k": k, "gram": signed(keys), "n": n.astype(np.int64), "ends": ends.astype(np.int64)})

        def out() -> Iterator[pd.DataFrame]:
            places, ends, context, grams = grams_of(flat)
            for k in ORDERS if len(places) else ():
                some = wanted.has(grams[k])
                yield summed(k, grams[k][some], ends=ends[some])
            some = np.flatnonzero(wanted.has(context))
            yield summed(FOLLOWING, context[some])
            _, first, n = np.unique(grams[3][some], return_index=True, return_counts=True)
            below = [starts[plain(tokens[i])] for i in places[some[first]].tolist()]
            sizes = [len(b) for b in below]
            with np.errstate(over="ignore"):
                keys = mix(np.repeat(context[some[first]], sizes), np.array([c for b in below for c in b], dtype=np.uint64))
            real = wanted.has(keys)
            yield summed(LONGER, keys[real], np.repeat(n, sizes)[real])
            flat.clear()
            tokens.clear()

        for batch in batches:
            for t in batch[text]:
                if isinstance(t, str) and t:
                    found = TOKEN.findall(t)
                    tokens += [""] * len(LEAD)
                    tokens += found
                    flat += LEAD
                    flat += [codes[x] for x in found]
                if len(flat) > flush:
                    yield from out()
        if flat:
            yield from out()

    rows = documents.select(text).mapInPandas(count, "k int, gram long, n long, ends long")
    return rows.groupBy("k", "gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _digest(text: str) -> int:
    h = _hash(text.encode("utf-8", "surrogatepass"))
    return h - 2**64 if h >= 2**63 else h


def open_endings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per ending to judge."""

    kind = dict(documents.dtypes)[doc_id]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for batch in batches:
            ids, sources, texts = batch["d"].tolist(), batch["s"].tolist(), batch["t"].tolist()
            rows = [(ids[i], sources[i], len(texts[i]), _digest(texts[i]), *x) for i, *x in open_tails(texts, codes)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "length", "digest", "place", *[f"g{k}" for k in ORDERS], "context", "word", "own_end"])

    grams = ", ".join(f"g{k} long" for k in ORDERS)
    return documents.select(F.col(doc_id).alias("d"), folded(F.col("source")).alias("s"), F.col(text).alias("t")).mapInPandas(
        read, f"doc_id {kind}, source string, length int, digest long, place string, {grams}, context long, word string, own_end int"
    )


def wholeness(endings: DataFrame, grams: DataFrame) -> DataFrame:
    """digest, place, whole: how much the ending of a text, and of its copies, looks like one of a whole text, 0 to 1."""
    shape = [f"g{k}" for k in ORDERS] + ["context", "word", "own_end"]
    out = endings.groupBy("digest", "place").agg(*[F.first(c).alias(c) for c in shape], F.count("*").alias("copies"))
    kinds = {**{k: f"g{k}" for k in ORDERS}, FOLLOWING: "context", LONGER: "g3"}
    asked = F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("k", "gram")
    seen = out.select("digest", "place", "word", "own_end", "copies", asked).join(grams, ["gram", "k"], "left")
    by = seen.groupBy("digest", "place", "word", "own_end", "copies")
    by = by.agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in kinds for c in ("n", "ends")])
    less = lambda c, own: F.greatest(F.coalesce(c, F.lit(0)) - own, F.lit(0))
    p: Column = F.lit(0.05)
    known: Column = F.lit(True)
    for k in ORDERS:
        n = less(f"n{k}", F.col("copies"))
        known = known & (n > 0)
        p = F.when(known, (less(f"ends{k}", F.col("copies") * F.col("own_end")) + 2 * p) / (n + 2)).otherwise(p)
    same = less("n3", F.col("copies"))
    longer = F.when(F.col("word") == "0", 0).otherwise(F.coalesce(f"n{LONGER}", F.lit(0)))
    share = (same + 0.2) / (same + 0.2 + longer)
    novelty = F.when(same == 0, F.lit(3.0) / (F.lit(3.0) + less(f"n{FOLLOWING}", F.col("copies")))).otherwise(1.0)
    hanging = F.when(F.col("place") == "hanging", 0.2).otherwise(1.0)  # nothing whole ends with a comma
    return by.select("digest", "place", (p * share * novelty * hanging).alias("whole"))


def length_limits(documents: DataFrame, text: str = "text", least: int = 5, excess: float = 10.0) -> DataFrame:
    """source, length, texts, expected, censored: candidate limits and their censoring posterior."""
    hist = (
        documents.select(folded(F.col("source")).alias("source"), F.length(F.col(text)).alias("length"))
        .where("length > 0")
        .groupBy("source", "length")
        .agg(F.count("*").alias("texts"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        lengths, texts = pdf["length"].to_numpy(), pdf["texts"].to_numpy()
        total = int(texts.sum())
        upto = np.concatenate(([0], np.cumsum(texts)))
        near = upto[np.searchsorted(lengths, lengths + 30, "right")] - upto[np.searchsorted(lengths, lengths - 30)] - texts
        held = (texts >= least) & (texts >= excess * (near / 60 + 0.2))
        limits = np.flatnonzero(held).tolist()
        mu, sd = _censored_lognormal(np.log(lengths), texts, held)
        rows = []
        for i in limits:
            z = (math.log(lengths[i]) - mu) / sd
            expected = total * math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi) * lengths[i])
            rows.append((pdf["source"].iloc[0], lengths[i], texts[i], expected, min(0.99, max(0.0, (texts[i] - expected) / texts[i]))))
        return pd.DataFrame(rows, columns=["source", "length", "texts", "expected", "censored"])

    return hist.groupBy("source").applyInPandas(fit, "source string, length int, texts long, expected double, censored double")


def _censored_lognormal(x: np.ndarray, c: np.ndarray, held: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log lengths ``x``, each ``c`` times, by EM; held ones only say "at least this"."""
    total, free = c.sum(), ~held if not held.all() else held
    mu = float((x * c)[free].sum() / c[free].sum())
    sd = max(0.05, math.sqrt(float(((x - mu) ** 2 * c)[free].sum() / c[free].sum())))
    seen1, seen2 = float((x * c)[~held].sum()), float((x * x * c)[~held].sum())
    cut = list(zip(x[held].tolist(), c[held].tolist()))
    for _ in range(rounds):
        s1, s2 = seen1, seen2
        for at, n in cut:
            a = (at - mu) / sd
            tail = max(1e-12, 0.5 * math.erfc(a / math.sqrt(2)))
            hazard = min(math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail, abs(a) + 10)
            s1 += n * (mu + sd * hazard)
            s2 += n * (mu * mu + sd * sd + sd * (at + mu) * hazard)
        new = s1 / total
        sd, mu, old = max(0.05, math.sqrt(max(1e-6, s2 / total - new * new))), new, mu
        if abs(new - old) < 1e-9:
            break
    return mu, sd


def cut_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = TRANSFER_PRIOR) -> DataFrame:
    """doc_id, source, length, at_limit, log_odds of every text judged to be cut.

    Null and blank texts are not cut, nor are texts that end with a closed sentence. A null
    source is a source of its own; equal texts are judged alike; no length is special.
    """
    documents = documents.select(doc_id, "source", text)
    asked = materialise(open_endings(documents, doc_id, text), "endings")
    judged = materialise(wholeness(asked, count_grams(documents, text, asked=asked_of(asked))), "judged")
    endings = asked.select("doc_id", "source", "length", "digest", "place").join(judged, ["digest", "place"])
    limits = length_limits(documents, text).select(F.col("source").alias("ls"), F.col("length").alias("ll"), "censored")
    both = endings.join(limits, F.col("source").eqNullSafe(F.col("ls")) & (F.col("length") == F.col("ll")), "left")
    q = F.greatest(F.least(F.coalesce("censored", F.lit(0.0)), F.lit(LIMIT_TRUST)), F.lit(prior))
    odds = F.log(q / (1 - q)) + F.log((F.lit(1.005) - F.col("whole")) / (F.col("whole") + 0.005))
    judged = both.select("doc_id", "source", "length", (F.coalesce("censored", F.lit(0.0)) > 0.5).alias("at_limit"), odds.alias("log_odds")).where("log_odds > 0")
    return judged.groupBy("doc_id", "source", "length", "at_limit").agg(F.max("log_odds").alias("log_odds")).withColumnRenamed("doc_id", doc_id)


def cut_report(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """source, texts, cut, cut_at_limit, cut_share of every source."""
    texts = documents.select(folded(F.col("source")).alias("source")).groupBy("source").agg(F.count("*").alias("texts"))
    found = cut.groupBy("source").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
    j = texts.alias("t").join(found.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left")
    n = F.coalesce("cut", F.lit(0))
    return j.select("t.source", "texts", n.alias("cut"), F.coalesce("cut_at_limit", F.lit(0)).alias("cut_at_limit"), (n / F.col("texts")).alias("cut_share"))
