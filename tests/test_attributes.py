import pytest
from pyspark.sql import functions as F

from cindertrail.operators import attributes as A

CAT = [("retry_count", "int"), ("cpu_load", "dec"), ("is_canary", "bool"), ("first_seen", "time"), ("build_tag", "text")]
SCHEMA = "rec_no long, event_id long, attr_name string, attr_value string"


def cells(spark, rows, cat=CAT):
    df = spark.createDataFrame([(i, *r) if len(r) == 3 else r for i, r in enumerate(rows)], SCHEMA)
    return {(r.event_id, r.attr_name): r.attr_value for r in A.filled_cells(A.compact(A.wide_delta(df, sorted(cat))), sorted(cat)).collect()}


def read(spark, name, values):
    got = cells(spark, [(i, name, v) for i, v in enumerate(values)])
    return [got.get((i, name)) for i in range(len(values))]


def test_int(spark):
    values = ["7", "+7", " 42 ", "003", "1,234,567", "12,34", "5.0", "5.5", "1345.1e3", "4e3", "0x1F", "3 of 9", "12..4", "--4", "~3", "inf", "-5", "9" * 30]
    assert read(spark, "retry_count", values) == ["7", "7", "42", "3", "1234567", None, "5", None, "1345100", "4000", None, None, None, None, None, None, "-5", "9" * 30]


def test_dec(spark):
    values = ["1.5", "57,985", "73508e-3", ".906", "96.0010", "1.2.", "low", "nan", "0.2.5", "1,234.5", "+3", "1.0005"]
    assert read(spark, "cpu_load", values) == ["1.500", "57.985", "73.508", "0.906", "96.001", None, None, None, None, None, "3.000", "1.001"]


def test_bool(spark):
    values = ["TRUE", "f", "Y", "off", "1", "0", "maybe", "2", "ok", "yess"]
    assert read(spark, "is_canary", values) == ["true", "false", "true", "false", "true", "false", None, None, None, None]


def test_time(spark):
    values = ["2022-01-21T03:27:37Z", "2022-01-21 03:27:37", "20220121T032737Z", "21/Jan/2022:05:27:37 +0200", "1642735657", "1642735657000",
              "2022-01-21T12:27:37+09:00", "2022-01-21T03:27:37.5Z", "12:30", "yesterday", "2022-13-01T00:00:00Z", "2022-01-21"]
    t = "1642735657000"
    assert read(spark, "first_seen", values) == [t] * 7 + ["1642735657500", None, None, None, "1642723200000"]


def test_text_and_placeholders(spark):
    values = [" 0042 ", "Isle-4", "true", "", "  ", "-", "N/A", "none", "NULL", None]
    assert read(spark, "build_tag", values) == ["0042", "Isle-4", "true"] + [None] * 7


def test_names_and_versions(spark):
    rows = [(5, 1, "Retry.Count", "1"), (9, 1, "RETRY count", "n/a"), (7, 1, "retrycount", "2"), (8, 1, "count_retry", "3"), (6, 1, "retry-count", "4"), (1, 2, None, "1"), (2, None, "retrycount", "1")]
    assert cells(spark, rows) == {(1, "retry_count"): "2"}


def test_runs_merge_in_any_order(spark):
    df = spark.createDataFrame([(i, i % 3, CAT[i % 2][0], str(i)) for i in range(40)], SCHEMA)
    whole = A.compact(A.wide_delta(df, CAT))
    parts = [A.wide_delta(df.where(F.col("rec_no") % 4 == k), CAT) for k in (2, 0, 3, 1)]
    key = lambda d: {(r.event_id, r.attr_name, r.attr_value) for r in A.filled_cells(d, CAT).collect()}
    assert key(A.compact(*parts)) == key(whole) == key(A.compact(A.compact(*parts[:2]), A.compact(*parts[2:])))


def test_batches_are_merged_by_compaction(spark):
    """Deltas of batches hold what their own rows say; only compaction finds the newest."""
    df = spark.createDataFrame([(10, 1, "retry_count", "1"), (20, 1, "retry count", "2"), (30, 1, "retryCount", "?"), (15, 1, "build_tag", "x"), (21, 2, "build_tag", "y")], SCHEMA)
    deltas = A.wide_delta(df, CAT, batch=F.floor(F.col("rec_no") / 10))
    by_batch = {(r.batch, r.event_id): {k: (c.version, c.value) for k, c in r.cells.items()} for r in deltas.collect()}
    assert by_batch == {(1, 1): {"retrycount": (10, "1"), "buildtag": (15, "x")}, (2, 1): {"retrycount": (20, "2")}, (2, 2): {"buildtag": (21, "y")}}
    got = {(r.event_id, r.attr_name, r.attr_value) for r in A.filled_cells(A.compact(deltas), CAT).collect()}
    assert got == {(1, "retry_count", "2"), (1, "build_tag", "x"), (2, "build_tag", "y")}


def test_found_goes_through_compaction(spark, sf, monkeypatch):
    from cindertrail.plans import core_queries

    whole = core_queries.p3_found(spark, sf)
    monkeypatch.setattr(A, "BATCH", 20)  # many batches an entity, the same cells
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(core_queries.p3_found(spark, sf)) == key(whole)
    monkeypatch.setattr(A, "newer", lambda a, b: a)  # a compaction that keeps the wrong cells
    assert key(core_queries.p3_found(spark, sf)) != key(whole)


def test_typed_columns_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    wide = A.typed_wide(A.compact(A.wide_delta(df, CAT)), CAT)
    assert wide.collect() == [] and dict(wide.dtypes)["first_seen"] == "timestamp" and dict(wide.dtypes)["is_canary"] == "boolean"
    clash = spark.createDataFrame([(1, 1, "build_tag", "x", "y")], SCHEMA + ", version string")
    assert A.typed_wide(A.compact(A.wide_delta(clash, CAT)), CAT).first().build_tag == "x"


def test_catalogue_is_checked(spark):
    assert A.catalogue(spark.createDataFrame(CAT, "attr_name string, attr_type string")) == sorted(CAT)
    with pytest.raises(ValueError):
        A.catalogue(spark.createDataFrame([("a", "blob")], "attr_name string, attr_type string"))
