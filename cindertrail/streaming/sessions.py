"""The inactivity timers of ``operators.sessions`` as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cindertrail.functions.cleaning import user_key
from cindertrail.operators.sessions import GAP_US


def merge_intervals(intervals: list[tuple[int, int, int]], gap_us: int) -> list[tuple[int, int, int]]:
    """Join (first, last, n) intervals no more than ``gap_us`` apart, in time order."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(intervals):
        if out and first <= out[-1][1] + gap_us:
            a, b, k = out[-1]
            out[-1] = (a, max(b, last), k + n)
        else:
            out.append((first, last, n))
    return out


def stream_sessions(events: DataFrame, gap_us: int = GAP_US, lateness: str = "2 days", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a stream, emitted once the watermark passes ``end + gap``.

    State of a key: its open sessions, of which late rows may leave several. Every update
    merges into them and re-arms the key's event-time timer at the earliest end + gap; the
    expired timer emits the finished sessions. Rows older than ``lateness`` are dropped by
    the watermark, so ``lateness`` must cover the feed's longest delay.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        fresh: list[tuple[int, int, int]] = []
        if not state.hasTimedOut:
            for batch in batches:
                fresh += [(t, t, 1) for t in batch["ts_us"].tolist()]
        held = merge_intervals(held + fresh, gap_us)
        mark = state.getCurrentWatermarkMs() * 1000
        done = [s for s in held if s[1] + gap_us < mark]
        open_ = [s for s in held if s[1] + gap_us >= mark]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_)))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, (min(s[1] for s in open_) + gap_us) // 1000 + 1))
        else:
            if state.exists:
                state.remove()
        if done:
            yield pd.DataFrame([(key[0], *s) for s in done], columns=["user_id", "start_us", "end_us", "events"])

    keyed = (
        events.withColumn("__at", F.col(f"`{ts}`").cast("timestamp"))
        .withWatermark("__at", lateness)
        .select(user_key(F.col(f"`{user}`")).alias("key"), "__at", F.unix_micros("__at").alias("ts_us"))
        .where("key is not null and ts_us is not null")
    )
    return keyed.groupBy("key").applyInPandasWithState(
        step,
        "user_id string, start_us long, end_us long, events long",
        "firsts array<long>, lasts array<long>, counts array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
