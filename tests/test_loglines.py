import json

import pytest

from cindertrail.operators import loglines as L

SCHEMA = "line_id long, stream string, line_no long, raw_message string"
T = 1647221001147
LINES = {
    "T 2022-03-14T01:23:21.147Z billing] entering handler - see note": ("TRACE", "billing", "entering handler - see note"),
    "14/Mar/2022:02:23:21 +0100 stockroom[5846] information: reread: now [75]": ("INFO", "stockroom", "reread: now [75]"),
    "2022-03-14 01:23:21,147 WARN  [worker-1] cache.SlotMap - slow answer | x - y": ("WARN", "cache.SlotMap", "slow answer | x - y"),
    "[2022-03-14T01:23:21.147Z][\x1b[31mERR\x1b[0m][edge-proxy] peer level=info hint": ("ERROR", "edge-proxy", "peer level=info hint"),
    "1647221001147\tFTL\tsearch-node\tindex swap failed\tx": ("FATAL", "search-node", "index swap failed\tx"),
    "2022-03-14T01:23:21.147Z | dbg | mailer | 192.0.2.1 | PUT | /rpc | 0 | 7 | req-1 | - | a | b": ("DEBUG", "mailer", "a | b"),
    'ts=2022-03-14T01:23:21.147Z level=Warn component=basket msg="while \\"tray 1\\" \\\\ x"': ("WARN", "basket", 'while "tray 1" \\ x'),
    'level=info ts=1647221001147 msg="settled level=error" component=billing': ("INFO", "billing", "settled level=error"),
    '{"ts": 1647221001147, "severityNumber": 13, "service": "mailer", "msg": "x", "ctx": {"message": "inner"}}': ("WARN", "mailer", "x"),
}


def entries(spark, lines, **kw):
    rows = [(i, s, n, m) for i, (s, n, m) in enumerate(lines)]
    got = L.log_entries(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted((r.stream, r.first_line_no, r.last_line_no, r.ts_ms, r.level, r.component, r.msg) for r in got)


def test_layouts(spark):
    got = entries(spark, [("s", i, line) for i, line in enumerate(LINES)])
    assert [g[4:] for g in got] == list(LINES.values())
    assert {g[3] // 1000 for g in got} == {T // 1000}


def test_no_openers_among_continuations(spark):
    head = next(iter(LINES))
    more = ["2022-02-12 was the last clean run", "WARN limits: soft=1 hard=2", "95 | 89 | 8", "Caused by: x: ERROR [y] closed", "    " + head, "}", "    {", "", None, "  \r"]
    got = entries(spark, [("s", 1, "tail of a rotated file"), ("s", 2, head), *[("s", 3 + i, m) for i, m in enumerate(more)]])
    assert [g[1:3] for g in got] == [(2, 9)]


def test_printed_objects(spark):
    o = {"timestamp": "2022-03-14T01:23:21.147Z", "level": "Info", "service": "billing", "message": "a \"b\"", "ctx": {"message": "in"}}
    lines = json.dumps(o, indent=2).split("\n")
    rows = [("s", i, x + "\r") for i, x in enumerate(["x", *lines, "trace line", "", "{", '  "note": 1', "}", *lines[:-1]])]
    n = len(lines)
    got = entries(spark, rows)
    assert [(g[1], g[2], g[6]) for g in got] == [(1, n + 5, 'a "b"'), (n + 6, n + 6 + n - 2, 'a "b"')]


def test_blocks_and_hot_stream(spark):
    head = "[2022-03-14T01:23:21.147Z][INFO][edge-proxy] m"
    rows = [("hot", i, head if i % 50 == 7 else "more") for i in range(1000)] + [("cold", 3, head)]
    got = entries(spark, rows, block=16)
    assert [g[1:3] for g in got if g[0] == "hot"] == [(i, min(i + 49, 999)) for i in range(7, 1000, 50)]
    assert [g[1:3] for g in got if g[0] == "cold"] == [(3, 3)]


def test_empty_null_keys_and_long_lines(spark):
    assert entries(spark, []) == []
    long = "[2022-03-14T01:23:21.147Z][INFO][edge-proxy] " + "word " * 20_000
    got = entries(spark, [(None, 1, long), ("s", None, long), ("s", 1, long)])
    assert len(got) == 1 and len(got[0][6]) == 99_999


def test_tree_merges_and_keeps_times_apart():
    tree = L.TemplateTree(limit=3)
    for name in ("alpha", "beta"):
        tree.add(tuple(L.tokenize(f"[2022-03-14T01:23:21Z][INFO][{name}] done at once")[0]))
    (leaf,) = tree.leaves.values()
    assert leaf[0][0].count("<*>") == 1 and leaf[0][1] == 2
    assert L.map_fields(leaf[0][0]) == L.FieldMap(1, 4, 7, 9)
    assert L.TemplateTree.likeness(["<TS>", "a", "b"], ["x", "a", "b"]) == 0.0


def test_a_full_tree_still_counts_every_line():
    tree = L.TemplateTree(limit=2)
    for line in ("one two", "1 2 3", "a = b", "c ( d", "e f g", "<x> [y]"):
        tree.add(tuple(L.tokenize(line)[0]))
    assert sum(n for _, _, n in tree.rows()) == 6


STAMP = "2022-03-10T00:00:00Z"
UNSEEN = {
    "INFO {ts} {svc} - {msg}": "2022-03-10T00:00:00Z",
    "{ts} {svc} INFO {msg}": "2022-03-10T00:00:00Z",
    "{ts} [INFO] {svc}: {msg}": "2022-03-10T00:00:00Z",
    "{ts} host {svc}[12]: info: {msg}": "Mar 10 00:00:00",
    "{ts} INFO {svc} {msg}": "1646870400",
    "{ts} INFO [main] {svc} - {msg}": "2022-03-10T00:00:00Z",
}
TEXTS = ("peer closed the channel", "retry - again after 3 tries", "state: open", "took 12 ms for [3] items", "reread without changes since 2022", "tray full")


@pytest.mark.parametrize("layout", UNSEEN)
def test_layouts_are_learned_from_their_lines(spark, layout):
    """Signs, words and groups inside messages are told from the header by what all lines of a layout share."""
    lines = [(layout.format(ts=UNSEEN[layout], svc=svc, msg=msg), svc, msg) for svc in ("billing", "search-node", "edge.proxy", "mailer", "basket") for msg in TEXTS]
    got = entries(spark, [("s", i, line) for i, (line, _, _) in enumerate(lines)])
    assert [(g[4], g[5], g[6]) for g in got] == [("INFO", svc, msg) for _, svc, msg in lines]
    assert {g[3] for g in got} == {None if layout.startswith("{ts} host") else 1646870400000}


def test_shapes_are_the_masked_tokens(sf):
    import pyarrow.parquet as pq

    masks = L.Masks()
    lines = [*LINES, *pq.read_table(f"{sf}/raw_lines.parquet")["raw_message"].to_pylist(), 'a="x\\" y"z 1.2.3.4:80 (b)', "Mar  1 00:00:00 h a[1]: x:y", "1646870400 I z", "I x", "a|b | c |d| e|"]
    assert all(L.shape_of(x, masks) == tuple(L.tokenize(x)[0]) for x in map(L._clean, lines))


def test_access_log(spark):
    lines = [f'192.0.2.{i} - - [10/Mar/2022:00:00:0{i} +0000] "GET /x HTTP/1.1" 200 {i}' for i in range(5)] + ["10.0.0.1 - - is no time"]
    got = entries(spark, [("s", i, x) for i, x in enumerate(lines)])
    assert [g[1:] for g in got] == [(i, max(i, 5 * (i == 4)), 1646870400000 + 1000 * i, None, None, f'"GET /x HTTP/1.1" 200 {i}') for i in range(5)]


def test_number_of_fields_is_learned(spark):
    lines = [f"{STAMP} | INFO | mailer | 7 | {msg}" for msg in ("a", "b | c", "d", "e", "f | g | h")]
    got = entries(spark, [("s", i, x) for i, x in enumerate([*lines, f"{STAMP} | INFO | short"])])
    assert [g[5:] for g in got] == [("mailer", m) for m in ("a", "b | c", "d", "e", "f | g | h")]
    tight = [f"{STAMP} | INFO | mailer | 7|8 | m{i}|n" for i in range(6)]  # bars without blanks are no separators
    assert [g[5:] for g in entries(spark, [("s", i, x) for i, x in enumerate(tight)])] == [("mailer", f"m{i}|n") for i in range(6)]


@pytest.mark.parametrize("value, level", [("W", "WARN"), ("wrn", "WARN"), (17, "ERROR"), ("21", "FATAL"), ("\x1b[31mInf\x1b[0m", "INFO"), ("x", None), (None, None), (True, None)])
def test_levels(value, level):
    assert L.level_of(value) == level


def test_template_table(spark):
    df = spark.createDataFrame([(i, "s", i, x) for i, x in enumerate(LINES)], SCHEMA)
    t = L.template_table(df).collect()
    assert len(t) == 8 and all(r.opens_entry for r in t)  # the JSON line is no template


def test_fields_after_the_templates_last_token(spark):
    pairs = " ".join(f"k{i}=v{i}" for i in range(20))
    ids = "2022-03-14T01:23:21.147Z | dbg | mailer | 192.0.2.1 | GET | /v1/items?ids=" + ",".join(map(str, range(25))) + " | 200 | 7 | req-1 | - | a | b"
    late = [f'ts={T} {pairs} level=warn msg="late {w}" service=basket' for w in ("one", "two", "three")]
    got = entries(spark, [("s", i, x) for i, x in enumerate([*late, ids, f"ts={T} {pairs} note=x"])])
    assert [g[4:] for g in got] == [*[("WARN", "basket", f"late {w}") for w in ("one", "two", "three")], ("DEBUG", "mailer", "a | b")]
    assert got[-1][1:3] == (3, 4)
    df = spark.createDataFrame([(i, "s", i, x) for i, x in enumerate([*late, ids, f"ts={T} {pairs} note=x"])], SCHEMA)
    assert sorted((r.lines, r.opens_entry) for r in L.template_table(df).collect()) == [(1, False), (1, True), (3, True)]


def test_layout_tokens_are_never_merged(spark):
    time, text = "2022-03-14T01:23:21.147Z", "peer closed the channel early"
    lines = [f"{time} WARN [w-9] catalog {sep} {text}" for sep in "-:"]
    lines += [f'ts={T} {key}=warn component=basket msg="x"' for key in ("lvl", "level", "severity")]
    lines += [f"[{time}][INFO][edge {sep} {text} x] y" for sep in ("]", "a")]  # the second opens no entry
    got = entries(spark, [("s", i, x) for i, x in enumerate(lines)])
    assert [g[4:] for g in got] == [*[("WARN", "catalog", text)] * 2, *[("WARN", "basket", "x")] * 3, ("INFO", "edge", f"{text} x] y")]
    tree = L.TemplateTree()
    for line in lines:
        tree.add(tuple(L.tokenize(line)[0]))
    for line in lines:
        tokens = tuple(L.tokenize(line)[0])
        assert L.map_fields(tree.known[tokens][0]) == L.map_fields(tokens)


def test_members_after_the_most_object_lines(spark):
    ctx = {"message": "in", "ts": 1, "steps": [{"msg": i, "level": "fatal"} for i in range(20)]}
    late = {"ctx": ctx, "timestamp": "2022-03-14T01:23:21.147Z", "level": "Info", "service": "billing", "message": "late", "more": ctx}
    twice = json.dumps(late, indent=2).replace('"more": {', '"message": "later",\n  "more": {')
    early = {"timestamp": "2022-03-14T01:23:22.147Z", "message": "early", "ctx": ctx}
    none = {"ctx": ctx, "note": 1}
    texts = [json.dumps(late, indent=2), twice, json.dumps(early, indent=2), json.dumps(none, indent=2)]
    lines = "\n".join(texts).split("\n")
    got = entries(spark, [("s", i, x) for i, x in enumerate(lines)], max_object_lines=5)
    assert [g[4:] for g in got] == [("INFO", "billing", "late"), ("INFO", "billing", "later"), (None, None, "early")]
    assert got == entries(spark, [("s", i, x) for i, x in enumerate(lines)]) and got[-1][2] == len(lines) - 1
