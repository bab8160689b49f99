"""Evaluation texts leaking into training text, found over canonical template windows.

Texts become words (runs of letters and digits, lower case). Each word is canonicalised:
words with a digit to <num>, units to <unit>, words that few evaluation items use to <name>;
the rest, the wording of the questions, stays. Every window of 13 canonical words is a
template; its slots are the words behind the placeholders. Documents and items are joined by
the hash of the template, and their slots are checked: slots with the item's own fillers mean
the very same passage; slots that map one to one onto others all along the match mean the
question with other names and numbers put in.

A window with too little wording to be a template (under ``min_wording`` kept words) is
keyed by its words themselves, so that no passage is lost and no key is shared by the whole
corpus. Documents are never compared with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.session import materialise

try:
    from xxhash import xxh3_64_intdigest as _hash
except ImportError:
    from hashlib import blake2b

    def _hash(b: bytes) -> int:
        return int.from_bytes(blake2b(b, digest_size=8).digest(), "little")


WINDOW = 13
#: Unit words.
UNITS = ("ms", "s", "sec", "second", "seconds", "minute", "minutes", "min", "hour", "hours", "day", "days", "week", "weeks", "beats", "percent", "bytes", "kb", "mb", "gb")
#: Wording is read to the driver and broadcast; more words than this are refused (ask for a higher ``name_max_items``).
MAX_WORDING = 1_000_000
#: Item templates broadcast to the tasks as a filter (8 bytes each); beyond this all windows go to the join, with the same result.
MAX_FILTER = 1_000_000
WORD = re.compile(r"[^\W_]+")
NUMERIC = re.compile(r"\d")
BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def words(text: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts], dtype=object)

    return run(text)


def wording(items: DataFrame, name_max_items: int, text: str = "text") -> list[str]:
    """Words of more than ``name_max_items`` items: the wording shared by the questions."""
    used = items.select(F.explode(F.array_distinct(words(F.col(text)))).alias("w")).groupBy("w").agg(F.count("*").alias("items"))
    rows = used.where(F.col("items") > name_max_items).limit(MAX_WORDING + 1).collect()
    if len(rows) > MAX_WORDING:
        raise ValueError(f"more than {MAX_WORDING} words in over {name_max_items} items")
    return [r.w for r in rows]


class Shapes(dict):
    """Words to (hash, hash of the canonical word, 1 if it is wording). Emptied when it grows large."""

    def __init__(self, kept: frozenset[str]):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if NUMERIC.search(word):
            shape = "<num>"
        elif word in UNITS:
            shape = "<unit>"
        else:
            shape = word if word in self.kept else "<name>"
        if len(self) > 500_000:
            self.clear()
        own = _hash(word.encode("utf-8", "surrogatepass"))
        self[word] = found = (own, own if shape == word else _hash(shape.encode()), int(shape == word))
        return found


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every window of ``size`` codes, in place of ``size`` strings."""
    n = len(codes) - size + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(BASE) + codes[i : i + n]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def template_windows(df: DataFrame, key: str, wording: Broadcast, size: int = WINDOW, min_wording: int = 4, text: str = "text", only: Broadcast | None = None) -> DataFrame:
    """key, pos (from 1), template, slots: hashes of every window's template and of its slots' fillers.

    The slots of a window without a template are empty: its words are its key. ``only``: sorted
    template hashes; windows of other templates are left out.
    """
    kind = dict(df.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = Shapes(wording.value)
        some = only.value if only is not None else None
        for batch in batches:
            keys, sizes, found = [], [], []
            for k, t in zip(batch["key"], batch["text"]):
                w = words_of(t)
                if len(w) >= size:
                    keys.append(k)
                    sizes.append(len(w))
                    found += [shapes[x] for x in w]
            if not keys:
                continue
            own, canon, kept_word = (np.array(c, dtype=np.uint64) for c in zip(*found))
            doc = np.repeat(np.arange(len(keys)), sizes)
            n = len(doc) - size + 1
            inside = doc[:n] == doc[size - 1 :]
            upto = np.concatenate(([0], np.cumsum(kept_word.astype(np.int64))))
            shared = upto[size:] - upto[:-size] >= min_wording
            template = np.where(shared, rolling(canon, size), rolling(own, size) ^ np.uint64(BASE)).view(np.int64)
            if some is not None:
                place = np.searchsorted(some, template)
                place[place == len(some)] = 0
                inside &= some[place] == template if len(some) else False
            fillers = rolling(np.where(kept_word > 0, np.uint64(0), own), size)  # by place; the wording counts nothing
            slots = np.where(shared, fillers, np.uint64(0))
            at = np.flatnonzero(inside)
            first = np.concatenate(([0], np.cumsum(sizes)))[doc[at]]
            yield pd.DataFrame({"key": np.array(keys, dtype=object)[doc[at]], "pos": at - first + 1, "template": template[at], "slots": slots.view(np.int64)[at]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInPandas(scan, f"key {kind}, pos int, template long, slots long")


def template_matches(
    documents: DataFrame, items: DataFrame, name_max_items: int = 8, size: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id"
) -> tuple[DataFrame, DataFrame]:
    """Windows of the documents (those of item templates only, if these are few) and of the items."""
    context = documents.sparkSession.sparkContext
    kept = context.broadcast(frozenset(wording(items, name_max_items)))
    evals = template_windows(items, item_id, kept, size).withColumnsRenamed({"key": item_id, "pos": "item_pos", "slots": "item_slots"})
    evals = materialise(evals, "items")
    some = [r.template for r in evals.select("template").distinct().limit(MAX_FILTER + 1).collect()]
    only = context.broadcast(np.sort(np.array(some, dtype=np.int64))) if len(some) <= MAX_FILTER else None
    docs = template_windows(documents, doc_id, kept, size, only=only).withColumnsRenamed({"key": doc_id, "pos": "doc_pos", "slots": "doc_slots"})
    return docs, evals


def held_passages(docs: DataFrame, evals: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """Windows of a document with an item's template whose slots hold the item's own fillers."""
    evals = evals.select("template", "item_slots", item_id).distinct()
    return docs.join(evals, (docs["template"] == evals["template"]) & (docs["doc_slots"] == evals["item_slots"])).select(doc_id, item_id, "doc_pos")


def leaks(documents: DataFrame, items: DataFrame, name_max_items: int = 8, size: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, windows, words of every document and item that share ``size`` words in a row.

    Null, empty and short texts leak nothing; a repeated passage counts once per place in the
    document. The item side is spread to all tasks only while Spark finds it under its
    broadcast threshold; larger sets of items are joined by shuffling window hashes.
    """
    hits = held_passages(*template_matches(documents, items, name_max_items, size, doc_id, item_id), doc_id, item_id)
    spans = hits.groupBy(doc_id, item_id).agg(F.count_distinct("doc_pos").alias("windows"), F.min("doc_pos").alias("first_word"), F.max("doc_pos").alias("last"))
    return spans.select(doc_id, item_id, "windows", (F.col("first_word") - 1).alias("first_word"), (F.col("last") + (size - 2)).alias("last_word"))


def word_codes(text: Column, own: bool = True) -> Column:
    """The words of a text as numbers: hashes, or, unless ``own``, for each the first place of its word in the text."""

    def codes(t: str | None) -> list[int]:
        w = words_of(t)
        first: dict[str, int] = {}
        if own:
            return np.array([_hash(x.encode("utf-8", "surrogatepass")) for x in w], dtype=np.uint64).view(np.int64).tolist()
        return [first.setdefault(x, i) for i, x in enumerate(w)]

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([codes(t) for t in texts], dtype=object)

    return run(text)


def one_to_one(a: Column, b: Column) -> Column:
    """Whether the elements of two lists of one length map one to one onto each other, place by place."""
    pairs = F.size(F.array_distinct(F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


def _members(evals: DataFrame, item_id: str) -> DataFrame:
    """item_id, class_id, t: items of one template sequence are a class, named by its smallest item."""
    seen = evals.groupBy(item_id).agg(F.sort_array(F.collect_set(F.struct("item_pos", "template"))).alias("t"))  # as long as an item
    seen = seen.withColumn("key", F.xxhash64(F.lit(11), "t"))
    return seen.join(seen.groupBy("key").agg(F.min(item_id).alias("class_id")), "key").select(item_id, "class_id", "t")


def item_classes(items: DataFrame, name_max_items: int = 8, size: int = WINDOW, item_id: str = "item_id") -> DataFrame:
    """item_id, class_id: which items are one question with other names and numbers (shorter ones than ``size`` words are in none)."""
    kept = items.sparkSession.sparkContext.broadcast(frozenset(wording(items, name_max_items)))
    return _members(template_windows(items, item_id, kept, size).withColumnsRenamed({"key": item_id, "pos": "item_pos"}), item_id).drop("t")


def variants(
    documents: DataFrame, items: DataFrame, name_max_items: int = 8, size: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id"
) -> DataFrame:
    """doc_id, class_id, windows, share, links, exact: re-parameterised questions, one row per document and class.

    A run of windows with the templates of a class counts for those of its items whose slots map
    one to one onto the document's all along the run. ``links`` is the number of such items (those
    held word for word among them), ``exact`` how many items of the class the document holds word
    for word, ``windows`` the windows of the runs, ``share`` the part of the question's windows in
    the longest run. A single window counts; questions often share a clause, and ``share`` tells
    such a passage from the whole question. ``item_classes`` names the members; documents are never
    paired with them one by one: whether slots map one to one depends only on which places hold
    the same word, so items alike in this are checked once.
    """
    docs, evals = template_matches(documents, items, name_max_items, size, doc_id, item_id)
    docs = materialise(docs, "windows")
    members = materialise(_members(evals, item_id), "members")
    long = members.groupBy("class_id").agg(F.max(F.size("t")).alias("whole"))
    shapes = members.select("class_id", F.explode("t").alias("x")).select("class_id", "x.item_pos", "x.template").distinct()
    hits = docs.join(shapes, "template").select(doc_id, "class_id", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("shift"))
    line = Window.partitionBy(doc_id, "class_id", "shift").orderBy("item_pos")
    hits = hits.withColumn("island", F.col("item_pos") - F.row_number().over(line))
    runs = hits.groupBy(doc_id, "class_id", "shift", "island").agg(F.count("*").alias("windows"), F.min("item_pos").alias("from_pos"), F.max("item_pos").alias("to_pos"))
    runs = materialise(runs, "runs")
    doc_words = documents.join(runs.select(doc_id).distinct(), doc_id).select(doc_id, word_codes(F.col("text")).alias("dw"))
    n = F.col("to_pos") - F.col("from_pos") + size
    runs = runs.join(doc_words, doc_id).select(doc_id, "class_id", "windows", "from_pos", n.alias("n"), F.slice("dw", F.col("from_pos") + F.col("shift"), n).alias("dp"))
    texts = items.groupBy(item_id).agg(F.first("text").alias("text")).select(item_id, word_codes(F.col("text"), own=False).alias("ip"))
    alike = members.select(item_id, "class_id").join(texts, item_id).groupBy("class_id", "ip").agg(F.count("*").alias("items"))
    both = runs.join(alike, "class_id").select(doc_id, "class_id", "windows", "items", "ip", F.slice("ip", F.col("from_pos"), F.col("n")).alias("part"), "dp")
    same = both.where(one_to_one(F.col("part"), F.col("dp")))
    per = same.groupBy(doc_id, "class_id", "ip").agg(F.sum("windows").alias("windows"), F.max("windows").alias("run"), F.max("items").alias("items"))
    found = per.groupBy(doc_id, "class_id").agg(F.max("windows").cast("long").alias("windows"), F.max("run").alias("run"), F.sum("items").cast("long").alias("links"))
    found = found.join(long, "class_id").select(doc_id, "class_id", "windows", (F.col("run") / F.col("whole")).alias("share"), "links")
    held = held_passages(docs, evals, doc_id, item_id).select(doc_id, item_id).distinct().join(members.select(item_id, "class_id"), item_id)
    held = held.groupBy(doc_id, "class_id").agg(F.count("*").alias("exact"))
    return found.join(held, [doc_id, "class_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(0)).cast("long"))
