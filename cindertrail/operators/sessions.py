"""Grouping activity into sessions with keyed inactivity timers.

The rule is that of a keyed streaming timer: an ordered update of a key opens a session
and sets the key's timer to ``last event + gap``; each further update before the timer
resets it; a timer that expires emits the session's final start, end and count.

At scale one key may hold a third of all rows, so events are first folded, map-side, into
one update per key and ``gap``-wide slot of time (first, last, count). Two events of one
slot are less than ``gap`` apart, hence always in one session, and the fold is exact. A
key then has at most span / gap updates whatever its number of events, and these ordered
updates drive the timers in one pass per partition.
``cindertrail.streaming.sessions`` runs the same timers in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import row_digest, user_key

GAP_US = 30 * 60 * 1_000_000


class SessionTimers:
    """Inactivity timers of many keys fed with updates in (key, time) order.

    Only the key being read can have a running timer: the order guarantees that a change
    of key means that no further update of the former key follows.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us
        self.key = None
        self.first = self.last = self.events = 0

    def update(self, key, first: int, last: int, events: int):
        """Feed one update; returns the session whose timer it found expired, if any."""
        if key == self.key and first <= self.last + self.gap:  # before the timer: reset it
            self.last = max(self.last, last)
            self.events += events
            return None
        fired = self.expire()
        self.key, self.first, self.last, self.events = key, first, last, events
        return fired

    def expire(self):
        """Fire the running timer: the final (key, start, end, events)."""
        fired = None if self.key is None else (self.key, self.first, self.last, self.events)
        self.key = None
        return fired


def slot_updates(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(key, ts_us) rows folded into one update per key and slot: key, slot, first, last, n."""
    return (
        events.withColumn("slot", F.floor(F.col("ts_us") / F.lit(gap_us)).cast("long"))
        .groupBy("key", "slot")
        .agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.count("*").alias("n"))
    )


def run_timers(updates: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Drive the timers over slot updates: one row per session (key, start_us, end_us, events)."""

    def drive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        timers, names = SessionTimers(gap_us), ["key", "start_us", "end_us", "events"]
        for batch in batches:
            rows = zip(*(batch[c].tolist() for c in ("key", "first", "last", "n")))
            fired = [s for s in (timers.update(*row) for row in rows) if s]
            if fired:
                yield pd.DataFrame(fired, columns=names)
        if last := timers.expire():
            yield pd.DataFrame([last], columns=names)

    return (
        updates.select("key", "first", "last", "n")
        .repartition(F.col("key"))
        .sortWithinPartitions("key", "first")
        .mapInPandas(drive, "key string, start_us long, end_us long, events long")
    )


def session_bounds(events: DataFrame, gap_us: int = GAP_US, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """user_id, start_us, end_us, events (copies counted) of every session.

    Rows without a user (null, blank, ``-``) or without a time are in no session; an empty
    table has none; ties and repeated rows share a session; other columns are ignored.
    """
    keyed = events.select(user_key(F.col(f"`{user}`")).alias("key"), F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("ts_us"))
    keyed = keyed.where("key is not null and ts_us is not null")
    return run_timers(slot_updates(keyed, gap_us), gap_us).withColumnRenamed("key", "user_id")


def sessionize(
    events: DataFrame,
    gap_us: int = GAP_US,
    user: str = "user_id",
    ts: str = "ts",
    request: str = "request_id",
    copy_ignores: tuple[str, ...] = ("id", "ingested_at"),
) -> DataFrame:
    """Every session with duration, event count and distinct requests, copies not counted.

    A copy is a row equal to another in all columns but ``copy_ignores``. Null request ids
    count as events but not as requests. Null users and times as in ``session_bounds``.
    """
    h1, h2 = row_digest(events, copy_ignores)
    rows = (
        events.select(
            user_key(F.col(f"`{user}`")).alias("key"),
            F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("ts_us"),
            F.col(f"`{request}`").alias("request"),
            h1.alias("h1"),
            h2.alias("h2"),
        )
        .where("key is not null and ts_us is not null")
        .groupBy("key", "ts_us", "request", "h1", "h2")
        .agg(F.lit(1).alias("one"))
    )
    slot = F.floor(F.col("ts_us") / F.lit(gap_us)).cast("long")
    bounds = run_timers(slot_updates(rows.select("key", "ts_us"), gap_us), gap_us)
    slots = bounds.withColumn(
        "slot", F.explode(F.sequence(F.floor(F.col("start_us") / F.lit(gap_us)).cast("long"), F.floor(F.col("end_us") / F.lit(gap_us)).cast("long")))
    )
    asked = rows.where("request is not null").select("key", slot.alias("slot"), "request").distinct()
    requests = (
        slots.join(asked, ["key", "slot"]).select("key", "start_us", "request").distinct().groupBy("key", "start_us").agg(F.count("*").alias("requests"))
    )
    return bounds.join(requests, ["key", "start_us"], "left").select(
        F.col("key").alias("user_id"),
        "start_us",
        "end_us",
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "events",
        F.coalesce("requests", F.lit(0)).cast("long").alias("requests"),
    )
