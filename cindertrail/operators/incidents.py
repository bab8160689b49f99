"""Elevated-error windows as incidents: gaps and islands over fixed error windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import with_scalars
from cindertrail.functions.logcols import in_ms, is_error, normalize_message, ts_ms
from cindertrail.session import materialise

WINDOW_MS, FACTOR, LEAST, MAX_WINDOWS = 300_000, 3.0, 3, 5000


def _shape(errors: DataFrame, window_ms: int, factor: float, least: int, max_windows: int) -> DataFrame:
    s = errors.agg(F.min("ms").alias("origin"), F.max("ms").alias("latest"), F.count("*").alias("total")).where("total > 0")
    s = s.withColumn("windows", F.least(F.lit(max_windows), F.greatest(F.lit(1), F.expr(f"cast(ceil(greatest({window_ms}, latest - origin + 1) / {window_ms}) as bigint)"))))
    return s.withColumn("baseline", F.col("total") / F.col("windows")).withColumn("threshold", F.greatest(F.lit(least), F.ceil(F.lit(factor) * F.col("baseline"))).cast("long"))


def detect_incidents(events: DataFrame, window_ms: int = WINDOW_MS, factor: float = FACTOR, least: int = LEAST, max_windows: int = MAX_WINDOWS, limit: int = 200) -> DataFrame:
    """incident_id, start_ms, end_ms, errors, services (top three), pattern, threshold, baseline, those of most errors first.

    Windows are aligned to the first error; a run of windows at or over the threshold is an
    incident; its errors are those in [start, end), where the end is never after the last
    error. Errors beyond ``max_windows`` windows count in the last one. Ids number the incidents
    with errors by their start; ``limit`` is the length of the list.
    """
    errors = events.where(is_error(F.col("level")) & F.col("ts").isNotNull()).select("id", ts_ms().alias("ms"), "service", "message")
    shape = _shape(errors, window_ms, factor, least, max_windows)
    slotted = with_scalars(errors, shape.select("origin", "latest", "windows", "threshold", "baseline")).withColumn("slot", F.least(F.col("windows") - 1, F.expr(f"(ms - origin) div {window_ms}")))
    hot = slotted.groupBy("slot", "origin", "latest", "threshold", "baseline").agg(F.count("*").alias("n")).where("n >= threshold")
    # at most max_windows rows from here: one ordered pass
    island = F.col("slot") - F.row_number().over(Window.partitionBy("origin").orderBy("slot"))
    spans = hot.withColumn("island", island).groupBy("island", "origin", "latest", "threshold", "baseline").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    spans = spans.select(
        (F.col("origin") + F.col("a") * window_ms).alias("start_ms"),
        F.least(F.col("latest"), F.col("origin") + (F.col("b") + 1) * window_ms).alias("end_ms"),
        "threshold", "baseline", F.explode(F.sequence("a", "b")).alias("slot"),
    )
    inside = slotted.select("id", "ms", "service", "message", "slot").join(spans, "slot").where("ms >= start_ms and ms < end_ms")
    by = ["start_ms", "end_ms", "threshold", "baseline"]
    # One pass over the errors of incidents; services, templates and totals are taken from its counts.
    cells = inside.groupBy(*by, F.coalesce("service", F.lit("?")).alias("service"), normalize_message(F.col("message")).alias("template"))
    cells = materialise(cells.agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "incidents")
    heads = cells.groupBy(*by).agg(F.sum("n").alias("errors"))
    heads = heads.withColumn("incident_id", F.row_number().over(Window.partitionBy().orderBy("start_ms")).cast("int"))

    def ranked(column: str) -> DataFrame:
        counts = cells.where(F.col(column).isNotNull()).groupBy("start_ms", column).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
        return counts.withColumn("r", F.row_number().over(Window.partitionBy("start_ms").orderBy(F.desc("n"), "first_id")))

    svc = ranked("service").where("r <= 3").groupBy("start_ms").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "service"))), lambda s: s["service"]), ",").alias("services"))
    tpl = ranked("template").where("r = 1").select("start_ms", F.col("template").alias("pattern"))
    out = heads.join(svc, "start_ms", "left").join(tpl, "start_ms", "left").orderBy(F.desc("errors"), "incident_id").limit(limit)
    return out.select("incident_id", "start_ms", "end_ms", "errors", "services", "pattern", "threshold", "baseline")


def events_in_window(events: DataFrame, from_ms: int, to_ms: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows of all levels in [from, to) in order of id, at most 1000."""
    if from_ms > to_ms:
        raise ValueError("from is after to")
    return events.where(in_ms(from_ms, to_ms)).orderBy("id").offset(max(0, offset)).limit(max(1, min(1000, limit)))


def incident_evidence(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident_id, id, level of every event inside an incident (interval join on shared slots)."""
    slots = incidents.withColumn("slot", F.explode(F.expr(f"sequence(start_ms div {WINDOW_MS}, end_ms div {WINDOW_MS})")))
    e = events.where("ts is not null").select("id", "level", ts_ms().alias("ms")).withColumn("slot", F.expr(f"ms div {WINDOW_MS}"))
    return e.join(slots.select("incident_id", "start_ms", "end_ms", "slot"), "slot").where("ms >= start_ms and ms < end_ms").select("incident_id", "id", "level")
