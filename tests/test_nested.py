import json

from cindertrail.operators.nested import FRAME_RELS, Rel, child_rows, children, shred, shred_frames

SCHEMA = "frame_id long, session_id string, seq long, received_at timestamp, payload string"
EV = {"algorithm": "scan", "references": ["r1", None, "r2"]}
INC = {"id": 7, "title": "t", "evidence": [EV, None]}
WANT = {
    ("health", "", "a"), ("incident", "", "7"), ("evidence", "7", "scan"), ("reference", "7/scan", "r1"), ("reference", "7/scan", "r2"),
    ("node", "", "n"), ("edge", "", "n>m"),
}
TOPO = {"nodes": [{"id": "n"}], "edges": [{"source": "n", "target": "m"}]}


def frame(health, incidents, topology=TOPO):
    return json.dumps({"health": health, "incidents": incidents, "topology": topology, "x": 1})


def rows(spark, payloads, keys=None):
    data = [(i, "s", (keys or range(len(payloads)))[i], None, p) for i, p in enumerate(payloads)]
    return child_rows(shred_frames(spark.createDataFrame(data, SCHEMA))).collect()


def test_shapes_of_all_producers_agree(spark):
    shapes = [
        frame([{"service": "a", "state": "ok"}, None], [INC]),
        frame({"a": {"state": "ok"}}, INC),
        frame({"a": {"state": "ok"}}, json.dumps([INC])),
        frame([{"service": "a", "state": "ok"}], [{**INC, "evidence": {**EV, "references": ["r1", "r2"]}}]),
        frame(json.dumps({"a": {"state": "ok"}}), [{**INC, "evidence": json.dumps([EV])}], json.dumps(TOPO)),
    ]
    got = {}
    for r in rows(spark, shapes):
        got.setdefault(r.seq, set()).add((r.rel, r.parent_key, r.child_key))
    assert all(got[i] == WANT for i in range(len(shapes)))


def test_single_reference_as_text():
    assert children("ref-1", ()) == ["ref-1"] and children(None, ()) == [] and children("", ()) == []


def test_unreadable_frames_and_frames_sent_again(spark):
    good = frame([{"service": "a"}], [])
    got = rows(spark, [None, "", "no json", "[1]", '"x"', good[:-3], good, good], [0, 1, 2, 3, 4, 5, 5, 6])
    assert {(r.seq, r.child_key) for r in got if r.rel == "health"} == {(5, "a"), (6, "a")}
    again = rows(spark, [good, good], [1, 1])
    assert len([r for r in again if r.rel == "health"]) == 1


def test_identity_is_by_content_and_stored_once(spark):
    a = json.dumps({"health": [{"service": "a", "load": 1}, {"load": 1, "service": "a"}]})
    s = shred_frames(spark.createDataFrame([(0, "s", 0, None, a), (1, "s", 1, None, a)], SCHEMA))
    assert s.bridge.count() == 4
    objects = s.objects.where("rel = 'health'").collect()
    assert len(objects) == 1 and json.loads(objects[0].body) == {"load": 1, "service": "a"}
    assert {r.ordinal for r in s.bridge.collect()} == {0, 1}
    assert {r.occurrences for r in s.objects.collect()} == {2, 4}
    assert s.frames.select("hash").distinct().count() == 1


def test_objects_of_later_deliveries_are_none(spark):
    """A frame sent again with other content adds nothing, neither rows nor objects."""
    first, again = (json.dumps({"health": [{"service": x}]}) for x in "ab")
    s = shred_frames(spark.createDataFrame([(5, "s", 1, None, first), (6, "s", 1, None, again)], SCHEMA))
    assert [r.label for r in s.objects.where("rel = 'health'").collect()] == ["a"] and s.objects.count() == 2
    assert [r.child_key for r in child_rows(s).collect()] == ["a"]


def test_deeper_relations(spark):
    rels = (Rel("a", "as", None, ("k",)), Rel("b", "bs", "a", ("k",)), Rel("c", "cs", "b", ("k",)), Rel("d", "ds", "c", ()))
    p = json.dumps({"as": [{"k": 1, "bs": {"k": 2, "cs": [{"k": 3, "ds": ["x", "y"]}]}}]})
    got = child_rows(shred_frames(spark.createDataFrame([(1, "s", 1, None, p)], SCHEMA), rels=rels), rels).collect()
    assert {(r.rel, r.parent_key, r.child_key) for r in got} == {("a", "", "1"), ("b", "1", "2"), ("c", "1/2", "3"), ("d", "1/2/3", "x"), ("d", "1/2/3", "y")}


def test_hash_covers_subtree():
    one, two = (shred(frame([], [{**INC, "evidence": [{"algorithm": x}]}]))[2] for x in ("scan", "walk"))
    assert [n[4] for n in one if n[2] == "incident"] != [n[4] for n in two if n[2] == "incident"]
    assert [n[4] for n in one if n[2] == "node"] == [n[4] for n in two if n[2] == "node"]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", root string, nodes string")
    assert child_rows(shred_frames(df)).collect() == []
    assert len(FRAME_RELS) == 6


def test_very_long_payload(spark):
    big = json.dumps({"health": [{"service": f"s{i}", "note": "x" * 50} for i in range(3000)]})
    assert len(rows(spark, [big])) == 3000
