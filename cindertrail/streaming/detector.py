"""Sliding-window detection over a stream: bursts, latency and volume against running baselines.

State per key: the open buckets not yet passed by the watermark, the last bucket errors, a
latency histogram and two exponentially weighted baselines. A bucket is judged once, when the
watermark has passed its end, in order of time; late rows of closed buckets are dropped by
the watermark. ``batch_readings`` runs the same step function over a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_MS, LOOKBACK, RATIO, LEAST, BINS, BIN_MS, KEEP = 1000, 12, 2.2, 4, 60, 200, 0.85
COLUMNS = ["key", "bucket", "events", "errors", "baseline", "burst", "p95_ms", "latency_signal", "volume_signal"]
SCHEMA = "key string, bucket long, events long, errors long, baseline double, burst boolean, p95_ms long, latency_signal boolean, volume_signal boolean"
STATE = "buckets array<long>, events array<long>, errors array<long>, hists array<array<long>>, recent array<long>, histogram array<long>, volume double, p95 double"


@dataclass
class Detector:
    """The step function of one key; buckets must be closed in order."""

    recent: list[int] = field(default_factory=list)
    histogram: list[int] = field(default_factory=lambda: [0] * BINS)
    volume: float = 0.0
    p95: float = 0.0

    def close(self, bucket: int, events: int, errors: int, hist: list[int]) -> tuple:
        baseline = sum(self.recent) / len(self.recent) if self.recent else 0.0
        ratio = errors / baseline if baseline else (float("inf") if errors else 0.0)
        burst = errors >= LEAST and ratio >= RATIO
        self.histogram = [a + b for a, b in zip(self.histogram, hist)]
        p95 = self._quantile(0.95)
        slow = self.p95 > 0 and p95 >= 2 * self.p95
        loud = self.volume > 0 and events >= 2 * self.volume
        if not burst:  # baselines learn from quiet buckets only
            self.volume = events if self.volume == 0 else KEEP * self.volume + (1 - KEEP) * events
            self.p95 = p95 if self.p95 == 0 else round(KEEP * self.p95 + (1 - KEEP) * p95)
        self.recent = (self.recent + [errors])[-LOOKBACK:]
        return bucket, events, errors, baseline, burst, p95, slow, loud

    def _quantile(self, share: float) -> int:
        total, upto = sum(self.histogram), 0
        for i, n in enumerate(self.histogram):
            upto += n
            if total and upto >= share * total:
                return (i + 1) * BIN_MS
        return 0


def _fold(batches: Iterator[pd.DataFrame], open_: dict[int, list]) -> None:
    """Add a micro-batch to the open buckets, counted by bucket and latency bin first."""
    for b in batches:
        rt = pd.to_numeric(b["response_ms"], errors="coerce").fillna(0)
        cells = pd.DataFrame({"bucket": b["bucket"], "error": b["error"].astype(bool), "bin": (rt // BIN_MS).clip(upper=BINS - 1).where(rt > 0, -1).astype(int)})
        for (bucket, i), (n, bad) in cells.groupby(["bucket", "bin"])["error"].agg(["size", "sum"]).iterrows():
            cell = open_.setdefault(int(bucket), [0, 0, [0] * BINS])
            cell[0] += int(n)
            cell[1] += int(bad)
            if i >= 0:
                cell[2][i] += int(n)


def _prepared(events: DataFrame, key: str) -> DataFrame:
    ms = F.unix_millis("ts")
    return events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(key).alias("key"), "ts", F.floor(ms / BUCKET_MS).cast("long").alias("bucket"), F.coalesce(F.col("level").isin("ERROR", "FATAL"), F.lit(False)).alias("error"), F.col("response_ms").cast("long").alias("response_ms")
    )


def stream_readings(events: DataFrame, key: str = "service", lateness: str = "0 seconds") -> DataFrame:
    """Readings of every closed bucket of a stream of log events."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d, open_ = Detector(), {}
        if state.exists:
            buckets, ev, er, hists, recent, histogram, volume, p95 = state.get
            d = Detector(list(recent), list(histogram), volume, p95)
            open_ = {b: [x, y, list(h)] for b, x, y, h in zip(buckets, ev, er, hists)}
        if not state.hasTimedOut:
            _fold(batches, open_)
        mark = state.getCurrentWatermarkMs()
        done = sorted(b for b in open_ if (b + 1) * BUCKET_MS <= mark)
        rows = [(k[0], *d.close(b, *open_.pop(b))) for b in done]
        held = sorted(open_)
        state.update((held, [open_[b][0] for b in held], [open_[b][1] for b in held], [open_[b][2] for b in held], d.recent, d.histogram, float(d.volume), float(d.p95)))
        if held:
            state.setTimeoutTimestamp(max(mark + 1, (held[0] + 1) * BUCKET_MS))
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    e = _prepared(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), key)
    return e.groupBy("key").applyInPandasWithState(step, SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_readings(events: DataFrame, key: str = "service") -> DataFrame:
    """The same readings of a bounded table: buckets are aggregated first, then stepped in order."""
    e = _prepared(events, key)
    rt = F.when(F.col("response_ms") > 0, F.least(F.lit(BINS - 1), F.expr(f"cast(response_ms div {BIN_MS} as int)"))).otherwise(-1)
    bins = e.groupBy("key", "bucket", rt.alias("bin")).agg(F.count("*").alias("n"), F.count_if("error").alias("bad"))
    cells = bins.groupBy("key", "bucket").agg(
        F.sum("n").alias("events"), F.sum("bad").alias("errors"), F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts")
    )  # at most BINS + 1 entries a list

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, d = None, Detector()
        for b in batches:
            out = []
            for k, bucket, ev, er, held, counts in zip(b["key"], b["bucket"], b["events"], b["errors"], b["bins"], b["counts"]):
                if k != now:
                    now, d = k, Detector()
                hist = [0] * BINS
                for i, n in zip(held, counts):
                    if i >= 0:
                        hist[i] = int(n)
                out.append((k, *d.close(int(bucket), int(ev), int(er), hist)))
            yield pd.DataFrame(out, columns=COLUMNS)

    return cells.repartition("key").sortWithinPartitions("key", "bucket").mapInPandas(run, SCHEMA)


def replay_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def to_memory(stream: DataFrame, name: str, checkpoint: str):
    """Run a stream to its present end into an in-memory table; returns the finished query."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
