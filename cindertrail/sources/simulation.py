"""Simulated fleets: scenario curves, per-tick events, and a tick stream source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from cindertrail.functions.cleaning import unit as unit_of

TICK_MS, EVENTS_PER_SECOND, MAX_PER_TICK, COOLDOWN_TICKS = 250, 48.0, 120, 80


@dataclass(frozen=True)
class Scenario:
    """Ticks of onset, peak and recovery, and what the peak does to volume, errors and latency."""

    name: str
    ticks: int
    onset: int
    peak: int
    recovery: int
    volume: float
    errors: float
    latency_ms: int
    severity: str


#: The seven scenarios.
SCENARIOS = {
    s.name: s
    for s in (
        Scenario("checkout-5xx-cascade", 240, 12, 40, 168, 1.65, 0.34, 1850, "CRITICAL"),
        Scenario("database-latency-spike", 240, 16, 48, 176, 1.28, 0.14, 2400, "MAJOR"),
        Scenario("authentication-burst", 220, 10, 34, 150, 1.42, 0.27, 940, "MAJOR"),
        Scenario("cache-failure", 240, 14, 44, 172, 1.35, 0.19, 1650, "MAJOR"),
        Scenario("traffic-surge", 200, 8, 36, 140, 2.30, 0.11, 1250, "MINOR"),
        Scenario("deployment-regression", 260, 20, 60, 200, 1.10, 0.12, 1450, "MAJOR"),
        Scenario("payment-timeout", 240, 12, 42, 170, 1.22, 0.21, 3000, "CRITICAL"),
    )
}


#: What failing events say; own texts.
SIGNATURES = ("call refused upstream", "pool drained", "token not accepted")


def intensity(s: Scenario, tick: Column) -> Column:
    """0 before the onset, a ramp to 1 at the peak, 1 to the recovery, a ramp back to 0 at the end."""
    up = (tick - s.onset) / float(s.peak - s.onset)
    down = (F.lit(s.ticks) - tick) / float(s.ticks - s.recovery)
    return F.when(tick < s.onset, 0.0).when(tick < s.peak, up).when(tick < s.recovery, 1.0).when(tick < s.ticks, down).otherwise(0.0)


def phase(level: Column) -> Column:
    return F.when(level <= 0, "healthy").when(level < 0.35, "onset").when(level < 0.85, "degrading").otherwise("peak")


def simulate(spark: SparkSession, scenario: str, services: DataFrame, ticks: int | None = None, origin_ms: int = 1_646_611_200_000, seed: int = 42) -> DataFrame:
    """Events of every tick of a scenario, the calm after its end included; columns as in ``scenario_events``."""
    last = min(ticks or 10**6, SCENARIOS[scenario].ticks + COOLDOWN_TICKS)
    return scenario_events(spark.range(last).select(F.col("id").cast("int").alias("tick")), scenario, services, origin_ms, seed)


def scenario_events(ticks: DataFrame, scenario: str, services: DataFrame, origin_ms: int = 1_646_611_200_000, seed: int = 42) -> DataFrame:
    """Events of the given ``tick``s: tick, intensity, phase, id, ts, service, level, status, response_ms, message.

    Each value is a hash of (seed, tick, position), so any range of ticks can be made alone and
    again, in a batch or from a stream of ticks (``TickSource``). ``services`` (service,
    base_share) are the fleet; it is read as ranges of shares.
    """
    s = SCENARIOS[scenario]
    t = ticks.select("tick")
    t = t.withColumn("intensity", intensity(s, F.col("tick")))
    count = F.least(F.lit(MAX_PER_TICK), F.greatest(F.lit(1), F.round(F.lit(EVENTS_PER_SECOND * TICK_MS / 1000) * (1 + (s.volume - 1) * F.col("intensity"))).cast("int")))
    t = t.withColumn("count", count).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))

    def unit(salt: int) -> Column:
        return unit_of(seed, salt, F.col("tick"), F.col("n"))

    fleet = services.agg(F.sort_array(F.collect_list(F.struct("service", "base_share"))).alias("f"))  # a fleet, not data
    names = fleet.select(F.transform("f", lambda x: x["service"])).scalar()
    shares = fleet.select(F.transform("f", lambda x: x["base_share"])).scalar()
    t = t.withColumns({"names": names, "shares": shares, "pick": unit(1)})
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    upto = F.transform("shares", lambda x, i: F.aggregate(F.slice("shares", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y))
    at = F.size(F.filter(upto, lambda c: c <= F.col("pick") * total))
    failing = unit(2) < 0.004 + s.errors * F.col("intensity")
    e = t.withColumn("failing", failing).withColumn("service", F.element_at("names", F.least(at + 1, F.size("names"))))
    warn = unit(3) < 0.3
    base = 40 + unit(4) * 160
    return e.select(
        "tick", "intensity", phase(F.col("intensity")).alias("phase"), (F.col("tick") * 1000 + F.col("n")).cast("long").alias("id"),
        F.timestamp_millis(F.lit(origin_ms) + F.col("tick") * TICK_MS + F.floor(F.col("n") * TICK_MS / F.col("count"))).alias("ts"), "service",
        F.when(F.col("failing") & warn, "WARN").when(F.col("failing"), "ERROR").otherwise("INFO").alias("level"),
        F.when(F.col("failing"), 500).otherwise(200).alias("status"),
        (base + F.when(F.col("failing"), unit(5) * s.latency_ms * (0.5 + F.col("intensity"))).otherwise(0.25 * s.latency_ms * F.col("intensity") * unit(6))).cast("long").alias("response_ms"),
        F.when(F.col("failing"), F.element_at(F.array(*map(F.lit, SIGNATURES)), (unit(7) * len(SIGNATURES)).cast("int") + 1)).otherwise("request completed").alias("message"),
    )


class TickReader(SimpleDataSourceStreamReader):
    """Offsets are ticks; a read hands out the next ticks up to the last one."""

    def __init__(self, options: dict):
        self.last, self.step = int(options.get("ticks", 320)), int(options.get("perBatch", 40))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        stop = min(self.last, start["tick"] + self.step)
        return iter([(t,) for t in range(start["tick"], stop)]), {"tick": stop}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(t,) for t in range(start["tick"], end["tick"])])

    def commit(self, end: dict) -> None:
        pass


class TickSource(DataSource):
    """``spark.readStream.format("ticks")``: one row per tick of the logical clock."""

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return "tick int"

    def simpleStreamReader(self, schema: StructType) -> TickReader:
        return TickReader(self.options)
