"""Queries of the training-data problems 6 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.llm import cut_texts, leaks, mixture, percentiles, runs
from cindertrail.session import materialise, table

BY = ("service", "endpoint")
PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_events").where("service is not null and endpoint is not null and response_ms > 0")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles.percentiles(percentiles.frequencies(_recorded(spark, d), BY, "response_ms"), BY, {"p50": 0.5, "p95": 0.95})
    return found.where("n >= 20 and p95 >= 10 * p50").select(*BY)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(percentiles.frequencies(_recorded(spark, d), BY, "response_ms"), BY, PROBS)


def p6_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored frequency tables, those of even and of odd days, merged."""
    days = _recorded(spark, d).withColumn("odd", F.coalesce(F.dayofyear("ts"), F.lit(0)) % 2)
    tables = [materialise(percentiles.frequencies(days.where(F.col("odd") == k), BY, "response_ms"), "days") for k in (0, 1)]
    return percentiles.percentiles(percentiles.merge_frequencies(*tables), BY, PROBS)


def p6_bounded(spark: SparkSession, d: str) -> DataFrame:
    """service, endpoint, n, within: whether the percentiles of summaries of 1 % error keep within it."""
    exact = percentiles.percentiles(percentiles.frequencies(_recorded(spark, d), BY, "response_ms"), BY, PROBS)
    rough = percentiles.percentiles(percentiles.frequencies(_recorded(spark, d), BY, "response_ms", 0.01), BY, PROBS)
    ok = F.lit(True)
    for p in PROBS:
        ok = ok & (F.abs(F.col(f"r.{p}") - F.col(f"e.{p}")) <= 0.0100001 * F.col(f"e.{p}"))
    return exact.alias("e").join(rough.alias("r"), list(BY)).select(*BY, "e.n", ok.alias("within"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "log_events"), min_events=3).select("service", "first_id", "last_id")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "log_events"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_variants(spark: SparkSession, d: str) -> DataFrame:
    return leaks.variants(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return leaks.item_classes(table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.short_sources(mixture.shares(*_mix(spark, d)))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.cut_texts(table(spark, d, "documents")).select("doc_id")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return cut_texts.cut_report(docs, cut_texts.cut_texts(docs))


QUERIES = {
    f.__name__: f
    for f in (
        p6_found, p6_percentiles, p6_merged_days, p6_bounded, p7_found, p7_runs, p8_found, p8_leaks, p8_variants, p8_classes,
        p9_found, p9_mix, p9_shares, p10_found, p10_report,
    )
}
