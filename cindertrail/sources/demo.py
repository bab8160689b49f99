"""Seeded synthetic log events: a day of traffic with error bursts, row by row from hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import unit

#: Own names; the first service is the busiest.
SERVICES = ("gateway", "accounts", "catalog", "billing", "orders", "stock", "store-db", "mail")
#: Weight of the first service and of the others, what a burst adds, its length, and per burst its hour and service.
FIRST_WEIGHT, WEIGHT, BURST_WEIGHT, BURST_MS = 26, 9, 900, 600_000
BURSTS = ((2, 6), (6, 1), (11, 6), (15, 1), (19, 6), (22, 3))
#: Own shares of levels outside bursts, and of errors inside.
SHARES = (("INFO", 0.5), ("DEBUG", 0.6), ("WARN", 0.72), ("ERROR", 1.0))
BURST_ERRORS = 0.95
MESSAGES = {"INFO": "request completed", "DEBUG": "cache lookup completed", "WARN": "slow answer", "ERROR": "upstream gave no answer"}


def demo_events(spark: SparkSession, n: int = 14_000, seed: int = 20260913, end_ms: int = 1_773_000_000_000) -> DataFrame:
    """n events over the 24 hours up to ``end_ms``; the events of a burst stand in the first ten minutes of its hour."""
    u = lambda salt: unit(seed, salt, F.col("id"))
    at = (u(1) * 86_400_000).cast("long")
    e = spark.range(n).withColumn("at", at).withColumn("hour", F.expr("at div 3600000"))
    bursting = F.lit(-1)
    for hour, service in BURSTS:
        bursting = F.when(F.col("hour") == hour, service).otherwise(bursting)
    e = e.withColumn("bursting", bursting)
    weights = [F.lit(FIRST_WEIGHT if i == 0 else WEIGHT) + F.when(F.col("bursting") == i, BURST_WEIGHT).otherwise(0) for i in range(len(SERVICES))]
    upto, index = F.lit(0), F.lit(len(SERVICES) - 1)
    total = sum(weights[1:], weights[0])
    marks = []
    for w in weights:
        upto = upto + w
        marks.append(upto)
    for i in reversed(range(len(SERVICES) - 1)):
        index = F.when(u(2) * total < marks[i], i).otherwise(index)
    e = e.withColumn("i", index).withColumn("burst", F.col("i") == F.col("bursting"))
    level = F.lit("ERROR")
    for name, share in reversed(SHARES[:-1]):
        level = F.when(u(3) < share, name).otherwise(level)
    level = F.when(F.col("burst"), F.when(u(3) < BURST_ERRORS, "ERROR").otherwise("WARN")).otherwise(level)
    when = F.when(F.col("burst"), F.col("hour") * 3_600_000 + (u(4) * BURST_MS).cast("long")).otherwise(F.col("at"))
    e = e.withColumns({"ts": F.timestamp_millis(F.lit(end_ms - 86_400_000) + when), "service": F.element_at(F.array(*map(F.lit, SERVICES)), F.col("i") + 1), "level": level})
    text = F.lit(MESSAGES["INFO"])
    for name, m in MESSAGES.items():
        text = F.when(F.col("level") == name, m).otherwise(text)
    return e.select(
        "id", "ts", "level", "service",
        F.concat("service", F.lit("-"), (1 + (u(5) * 4).cast("int")).cast("string")).alias("host"),
        F.lit("GET").alias("http_method"), F.concat(F.lit("/v1/"), "service").alias("endpoint"),
        F.when(F.col("level") == "ERROR", 500).otherwise(200).alias("status"),
        (5 + u(6) * F.when(F.col("level") == "ERROR", 4000).otherwise(400)).cast("long").alias("response_ms"),
        F.concat(F.lit("req-"), (F.col("id") / 3).cast("long").cast("string")).alias("request_id"), text.alias("message"),
    )
