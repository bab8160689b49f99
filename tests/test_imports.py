import json

import pytest

from cindertrail.operators import imports as I

SCHEMA = "row_id long, batch string, row_no long, raw_message string"
GOOD = ["2022-03-09T15:53:03Z", "INFO", "svc", "1.2.3.4", "put", "/x", "0", "203", "r1", "-", "msg"]
NAMES = I.FIELDS


def variant(**kw):
    f = dict(zip(NAMES, GOOD)) | kw
    return [f[n] for n in NAMES]


def txt(f):
    return " | ".join(f)


def csv(f):
    return ",".join(f)


def jsonl(**kw):
    f = {n: v for n, v in zip(NAMES, GOOD)} | {"statusCode": 0, "responseTime": 203} | kw
    return json.dumps({k: v for k, v in f.items() if v != "DROP"})


CASES = [
    (txt(GOOD), "txt", None), ("  " + txt(GOOD) + "\r\n", "txt", None), (txt(GOOD[:-1]), "txt", "columns"), (txt(GOOD + ["x"]), "txt", "columns"),
    (txt(variant(message='5" tray')), "txt", None), (txt(variant(timestamp="2022-02-30T00:00:00Z")), "txt", "timestamp"),
    (txt(variant(timestamp="2022-03-09T15:53:03")), "txt", "timestamp"), (txt(variant(timestamp="2022-03-09T15:53:03.123456789Z")), "txt", None),
    (txt(variant(level="WARNING")), "txt", "level"), (txt(variant(httpMethod="HEAD")), "txt", "method"), (txt(variant(statusCode="600")), "txt", "status"),
    (txt(variant(statusCode="200.0")), "txt", "status"), (txt(variant(statusCode="99")), "txt", "status"), (txt(variant(responseTime="-1")), "txt", "latency"),
    (txt(variant(responseTime=str(2**63))), "txt", "latency"), (txt(variant(responseTime=str(2**63 - 1))), "txt", None), ("", "txt", "columns"),
    (csv(GOOD), "csv", None), (csv(GOOD[:-1] + ['"a, ""b""\nc"']), "csv", None), (csv(GOOD[:-1] + ['"open']), "csv", "quoting"),
    (csv(GOOD[:-1] + ['"a"b']), "csv", "quoting"), (csv(GOOD[:-1] + ['a"b']), "csv", "quoting"), (csv(GOOD[:-1] + ["a,b"]), "csv", "columns"),
    (csv(GOOD[:-1] + [""]), "csv", "message"), (csv(GOOD[:-1] + ['"  "']), "csv", "message"), (csv(variant(timestamp="x", level="y")), "csv", "timestamp"),
    (jsonl(), "jsonl", None), (jsonl(level="DROP", httpMethod=None, statusCode="DROP", responseTime=None), "jsonl", None), ("[" + jsonl() + "]", "jsonl", "json"),
    (jsonl()[:-1], "jsonl", "json"), (jsonl() + jsonl(), "jsonl", "json"), (jsonl(statusCode="200"), "jsonl", "status"), (jsonl(statusCode=200.0), "jsonl", "status"),
    (jsonl(statusCode=True), "jsonl", "status"), (jsonl(responseTime="5"), "jsonl", "latency"), (jsonl(responseTime=-5), "jsonl", "latency"), (jsonl(level=""), "jsonl", "level"),
    (jsonl(message=None), "jsonl", "message"), (jsonl(message=" "), "jsonl", "message"), (jsonl(timestamp=None), "jsonl", "timestamp"), (jsonl(extra={"a": 1}), "jsonl", None),
]


@pytest.mark.parametrize("record, kind, reason", CASES)
def test_diagnosis(record, kind, reason):
    assert I.diagnose(record, kind)[0] == reason


def load(spark, rows):
    return I.load_rows(spark.createDataFrame([(i, b, i, m) for i, (b, m) in enumerate(rows)], SCHEMA))


def test_blocks_agree_with_strict_reading(spark):
    rows = [(f"b.{k}", r) for _ in range(40) for r, k, _ in CASES] + [(f"b.{k}", g) for k, g in (("txt", txt(GOOD)), ("csv", csv(GOOD)), ("jsonl", jsonl(shard=3))) for _ in range(300)]
    got = {r.row_id: r for r in load(spark, rows).collect()}
    assert len(got) == len(rows)
    for i, (b, m) in enumerate(rows):
        reason, values = I.diagnose(m, b.split(".")[1])
        assert got[i].reason == reason
        if values:
            assert (got[i].level, got[i].status, got[i].response_ms, got[i].message, got[i].http_method, got[i].user_id) == (values[1], values[6], values[7], values[10], values[4], values[9])
            assert (got[i].attributes is None) == (values[11] is None)


def test_good_block_takes_the_fast_path():
    import pyarrow as pa

    for kind, record in (("txt", txt(GOOD)), ("csv", csv(GOOD)), ("jsonl", jsonl())):
        at, cols = I.survey(pa.array([record] * 5 + ["x"]), kind)
        assert at.tolist() == [0, 1, 2, 3, 4] and len(cols) == len(I.VALUES) and {len(c) for c in cols} == {5}


def test_bisection_isolates():
    upto = [0, 1, 1, 1, 2, 3, 3]
    assert list(I.isolate(upto, 0, 6)) == [0, 3, 4]
    assert list(I.isolate(upto, 1, 3)) == []


def test_odd_inputs(spark):
    got = load(spark, [("b.txt", None), (None, txt(GOOD)), ("b.xml", txt(GOOD)), ("b.txt", txt(variant(message="m" * 200_000)))]).orderBy("row_id").collect()
    assert [r.reason for r in got] == ["columns", "format", "format", None]
    assert load(spark, []).collect() == []


def test_report_and_split(spark):
    parsed = load(spark, [("b.txt", txt(GOOD)), ("b.txt", "x")])
    assert I.loaded(parsed).count() == 1 and I.rejected(parsed).first().reason == "columns"
    r = I.reject_report(parsed).first()
    assert (r.rows, r.rejected, r.reject_share) == (2, 1, 0.5)


@pytest.mark.parametrize(
    "members",
    [{"at": "2022-03-17T18:12:20Z"}, {"o": {"a": 1}}, {"o": {"b": [None, {}]}}, {"n": None}, {"n": 1}, {"n": 1.5, "m": "x"}, {"n": 10**30}, {"ok": True, "no": None}],
)
def test_attributes_are_as_written_on_both_paths(members):
    import pyarrow as pa

    records = [jsonl(**members), jsonl(o={"a": 2}), jsonl(n=2), jsonl()] * 30
    alone = [jsonl(**members)] * 100
    for block in (records, alone):
        strict = I._strict(block, "jsonl")[1][-1].to_pylist()
        assert I.survey(pa.array(block), "jsonl")[1][-1].to_pylist() == strict
        assert strict[0] == json.dumps(members, sort_keys=True)


@pytest.mark.parametrize("kind, good", [("txt", txt(variant())), ("csv", csv(variant())), ("jsonl", jsonl())])
def test_only_refused_records_are_read_strictly(monkeypatch, kind, good):
    import pyarrow as pa

    strict, seen = I._strict, []
    monkeypatch.setattr(I, "_strict", lambda records, kind: seen.extend(records) or strict(records, kind))
    records = [f"bad {i}" if i in (0, 7, 8, 60, 99) else good for i in range(100)]
    reasons = {i: r for at, piece, _ in I.parse_block(pa.array(records), kind) for i, r in zip(at.tolist(), piece.to_pylist())}
    assert sorted(reasons) == list(range(100)) and [i for i in range(100) if reasons[i]] == [0, 7, 8, 60, 99]
    assert sorted(seen) == sorted(r for r in records if r != good)


def test_broken_json_is_set_apart_where_the_reader_stops(monkeypatch):
    import pyarrow as pa

    strict, seen = I._strict, []
    monkeypatch.setattr(I, "_strict", lambda records, kind: seen.extend(records) or strict(records, kind))
    broken = jsonl()[:-5] + ",}"
    records = [broken if i in (0, 31, 32, 99) else jsonl(shard=i) for i in range(100)]
    got = {i: r for at, piece, _ in I.parse_block(pa.array(records), "jsonl") for i, r in zip(at.tolist(), piece.to_pylist())}
    assert [i for i in range(100) if got[i] == "json"] == [0, 31, 32, 99] and len(seen) <= 8
