"""Queries of the training-data problems 1 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.operators import attributes, imports, loglines, nested, sessions
from cindertrail.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_bounds(table(spark, d, "log_events")).select("user_id", "start_us", "end_us")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "log_events"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_rows(nested.shred_frames(table(spark, d, "sim_frames"), objects=False))


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    s = nested.shred_frames(table(spark, d, "sim_frames"))
    return s.objects.groupBy("rel").agg(F.count("*").alias("objects"), F.sum("occurrences").alias("occurrences"))


def _wide(spark: SparkSession, d: str):
    attrs = attributes.catalogue(table(spark, d, "attr_catalog"))
    deltas = attributes.wide_delta(table(spark, d, "event_attributes"), attrs, batch=attributes.batch_of(F.col("rec_no")))
    return attributes.compact(deltas), attrs


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return attributes.filled_cells(*_wide(spark, d))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return attributes.typed_wide(*_wide(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return loglines.log_entries(table(spark, d, "raw_lines"))


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    return loglines.template_table(table(spark, d, "raw_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return imports.rejected(imports.load_rows(table(spark, d, "import_rows"))).select("row_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return imports.loaded(imports.load_rows(table(spark, d, "import_rows")))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return imports.reject_report(imports.load_rows(table(spark, d, "import_rows")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_sessions, p2_found, p2_objects, p3_found, p3_wide, p4_found, p4_templates, p5_found, p5_loaded, p5_report)
}
