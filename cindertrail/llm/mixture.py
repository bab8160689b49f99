"""Mixing sources to target weights by balanced (cube-method) sampling.

A source whose target is r times its size takes every record floor(r) times and a sample
with inclusion probability r - floor(r) once more; a source that can't reach its target takes
every record ``max_repeats`` times. The sample is balanced on two totals, records and tokens:
the vector of inclusion probabilities moves in the null space of the two constraints, three
undecided records at a time, until each is 0 or 1. The records of a source fly in buckets told by their ids, each of
which leaves at most two undecided; these fly again in groups of buckets, then per source, and
only the last two are landed, at the smallest error in tokens. The choice depends on the
records and the seed alone, not on files, tasks or cores.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import folded, with_scalars
from cindertrail.llm.tokens import VOCABULARY, token_count
from cindertrail.session import materialise

EPS = 1e-9
#: Records of a source that make one bucket, about, and the buckets whose leftovers (two each) fly together before the last flight.
BUCKET, GROUP = 100_000, 512


def move(units: list[list], rng: random.Random) -> bool:
    """One step of three (or two equal) undecided units [x, tokens, ...]; False if none is possible."""
    t = [float(u[1]) for u in units]
    if len(units) == 3:
        d = [t[1] - t[2], t[2] - t[0], t[0] - t[1]]
        if not any(d):
            d = [1.0, -1.0, 0.0]
    elif len(units) == 2 and t[0] == t[1]:
        d = [1.0, -1.0]
    else:
        return False
    up = min(((1 - u[0]) / k if k > 0 else u[0] / -k) for u, k in zip(units, d) if k)
    down = min((u[0] / k if k > 0 else (1 - u[0]) / -k) for u, k in zip(units, d) if k)
    step = up if rng.random() * (up + down) < down else -down
    for u, k in zip(units, d):
        x = u[0] + step * k
        u[0] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
    return True


def undecided(x: float) -> bool:
    return EPS <= x <= 1 - EPS


class Flight:
    """Flight phase of one source over a stream of units; holds at most two undecided ones."""

    def __init__(self, seed: str):
        self.rng = random.Random(seed)
        self.open: list[list] = []

    def feed(self, unit: list) -> list[list]:
        """Add a unit [x, tokens, ...]; returns the units it decides."""
        if not undecided(unit[0]):
            return [unit]
        self.open.append(unit)
        done: list[list] = []
        while len(self.open) == 3 and move(self.open, self.rng):
            done += [u for u in self.open if not undecided(u[0])]
            self.open = [u for u in self.open if undecided(u[0])]
        return done

    def rest(self) -> list[list]:
        while len(self.open) == 2 and move(self.open, self.rng) and all(undecided(u[0]) for u in self.open):
            pass
        return self.open


def land(units: list[list]) -> list[list]:
    """Round the last units so that tokens, then records, are missed by the least."""
    if not units:
        return units
    tokens, count = sum(u[0] * u[1] for u in units), sum(u[0] for u in units)
    best = min(
        itertools.product((0.0, 1.0), repeat=len(units)),
        key=lambda xs: (abs(sum(x * u[1] for x, u in zip(xs, units)) - tokens), abs(sum(xs) - count), xs),
    )
    return [[x, *u[1:]] for x, u in zip(best, units)]


def measured(documents: DataFrame, doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (folded), tokens of every document."""
    return documents.select(F.col(doc_id).alias("doc_id"), folded(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("tokens"))


def mixing_plan(sized: DataFrame, targets: DataFrame, mix_tokens: int | None = None) -> DataFrame:
    """One row per target source: its size, target, whole repeats and sampled share.

    The mix is as large as all documents unless ``mix_tokens`` says otherwise. A source
    without documents has size 0; a null share is 0, a null or negative cap is 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("size_tokens"), F.count("*").alias("documents"))
    total = sizes.agg(F.coalesce(F.sum("size_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.select(
        folded(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")
    ).where("source is not null")
    wanted = F.col("target_share") * (F.lit(mix_tokens) if mix_tokens is not None else F.col("all_tokens"))
    plan = with_scalars(t.join(sizes, "source", "left"), total)
    plan = plan.withColumn("size_tokens", F.coalesce("size_tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    plan = plan.withColumn("target_tokens", wanted).withColumn("capped", F.col("size_tokens") * F.col("max_repeats") < F.col("target_tokens"))
    ratio = F.when(F.col("capped") | (F.col("size_tokens") == 0), F.col("max_repeats").cast("double")).otherwise(F.col("target_tokens") / F.nullif(F.col("size_tokens"), F.lit(0)))
    plan = plan.withColumn("ratio", ratio)
    return plan.select(
        "source", "target_share", "max_repeats", "documents", "size_tokens", "target_tokens", "capped",
        F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("pi"),
    )


UNIT = "doc_id long, source string, tokens long, whole int, x double, task long"
NAMES = ["doc_id", "source", "tokens", "whole", "x", "task"]


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, mix_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): doc_id, source, tokens, copies of the records in the mix, and the plan.

    No record is used more than its source's max_repeats. Records of sources without a target
    are not used, nor are records of no tokens.
    """
    sized = materialise(measured(documents, vocabulary=vocabulary), "tokens")
    plan = mixing_plan(sized, targets, mix_tokens)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.floor(F.col("documents") / BUCKET) + 1)
    units = sized.where("tokens > 0").join(plan.select("source", "whole", "pi", "documents"), "source")
    units = units.select("doc_id", "source", "tokens", "whole", F.col("pi").alias("x"), bucket.alias("task"))
    units = units.repartition("source", "task").sortWithinPartitions("source", "task", "doc_id", "tokens")

    def fly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, flight = None, None
        for batch in batches:
            out = []
            for doc, source, tokens, whole, x, task in batch[NAMES].itertuples(index=False, name=None):
                if (source, task) != now:
                    out += flight.rest() if flight else []
                    now, flight = (source, task), Flight(f"{seed}|{source}|{task}")
                out += flight.feed([x, tokens, doc, source, whole, task])
            yield frame(out)
        yield frame(flight.rest() if flight else [])

    def frame(out: list[list]) -> pd.DataFrame:
        return pd.DataFrame([(u[2], u[3], u[1], u[4], u[0], u[5]) for u in out], columns=NAMES)

    def again(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["task", "doc_id"])
            flight = Flight(f"{seed}|{pdf['source'].iloc[0]}|{pdf['task'].iloc[0]}|{last}")
            out = []
            for doc, source, tokens, whole, x, task in pdf[NAMES].itertuples(index=False, name=None):
                out += flight.feed([x, tokens, doc, source, whole, task])
            rest = flight.rest()
            return frame(out + (land(rest) if last else rest))

        return run

    def is_open(x="x"):
        return F.col(x).between(EPS, 1 - EPS)

    first = materialise(units.mapInPandas(fly, UNIT), "flight")
    left = first.where(is_open()).withColumn("team", F.floor(F.col("task") / GROUP))
    second = materialise(left.groupBy("source", "team").applyInPandas(again(False), UNIT), "flight")
    third = second.where(is_open()).groupBy("source").applyInPandas(again(True), UNIT)
    decided = first.where(~is_open()).unionByName(second.where(~is_open())).unionByName(third)
    chosen = decided.select("doc_id", "source", "tokens", (F.col("whole") + F.round("x").cast("int")).alias("copies")).where("copies > 0")
    return chosen, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """What the mix reached, per target source."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_records"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies")
    )
    total = got.agg(F.coalesce(F.sum("mix_tokens"), F.lit(0)).alias("all_mixed"))
    out = with_scalars(plan.join(got, "source", "left"), total)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("mix_tokens", "mix_records", "used_documents", "most_copies")]
    return out.select(
        "source", "target_share", "max_repeats", "documents", "size_tokens", "target_tokens", *zero,
        F.coalesce(F.col("mix_tokens") / F.nullif(F.col("all_mixed"), F.lit(0)), F.lit(0.0)).alias("reached_share"),
    )


def short_sources(reached: DataFrame) -> DataFrame:
    """Sources used up to the cap that still stay below their target."""
    return reached.where((F.col("mix_tokens") >= F.col("size_tokens") * F.col("max_repeats")) & (F.col("mix_tokens") < F.col("target_tokens"))).select("source")
