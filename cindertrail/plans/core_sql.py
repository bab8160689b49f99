"""Oracle SQL (DuckDB) of the core queries."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: Sessions by gaps and islands instead of timers.
_SESSIONS = """
WITH keyed AS (
  SELECT lower(trim(user_id, E' \\t\\n\\r')) AS user_id, epoch_us(ts) AS us, request_id,
         row_number() OVER (PARTITION BY ts, level, service, host, ip, http_method, endpoint, status, response_ms,
                            request_id, user_id, message, trace_id, source ORDER BY id) AS copy
  FROM log_events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
real AS (SELECT * FROM keyed WHERE user_id NOT IN ('', '-') AND copy = 1),
cut AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM real),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS n FROM cut)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us,
       count(*) AS events, count(DISTINCT request_id) AS requests
FROM numbered GROUP BY user_id, n"""
SQL["p1_sessions"] = _SESSIONS
SQL["p1_found"] = f"SELECT user_id, start_us, end_us FROM ({_SESSIONS})"

_PLAIN = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_NUMBER = "'[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d{1,2})?'"
_INT = "CASE WHEN regexp_full_match(v, '[+-]?\\d{1,3}(,\\d{3})+([.eE].*)?') THEN replace(v, ',', '') ELSE v END"
_DEC = "CASE WHEN regexp_full_match(v, '[+-]?\\d*,\\d+([eE][+-]?\\d+)?') THEN replace(v, ',', '.') ELSE v END"
_NOTHING = "('', '-', '--', '---', '?', 'none', 'null', 'nil', 'nan', 'n/a', 'na', 'n.a.', '#n/a', 'undefined', '(none)', '(null)', '<none>', '<null>', '\\n', '–', '—')"
_CELLS = f"""
WITH c AS (SELECT DISTINCT attr_name AS name, attr_type AS kind, {_PLAIN.format('attr_name')} AS k FROM attr_catalog),
r AS (SELECT event_id, rec_no, name, kind, trim(attr_value, E' \\t\\n\\r') AS v FROM event_attributes JOIN c ON k = {_PLAIN.format('attr_name')}
      WHERE event_id IS NOT NULL AND rec_no IS NOT NULL AND attr_value IS NOT NULL),
n AS (SELECT *, CASE WHEN kind = 'int' THEN {_INT} WHEN kind = 'dec' THEN {_DEC} END AS num FROM r WHERE lower(v) NOT IN {_NOTHING}),
p AS (SELECT *, CASE WHEN regexp_full_match(num, {_NUMBER}) THEN try_cast(num AS DECIMAL(38, 12)) END AS x, CASE
  WHEN kind <> 'time' THEN NULL
  WHEN regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?') THEN epoch_ms(try_cast(v || 'Z' AS TIMESTAMPTZ))
  WHEN regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)') THEN epoch_ms(try_cast(v AS TIMESTAMPTZ))
  WHEN regexp_full_match(v, '\\d{{8}}T\\d{{6}}Z') THEN epoch_ms(try_strptime(v, '%Y%m%dT%H%M%SZ'))
  WHEN regexp_full_match(v, '\\d\\d/[A-Za-z]{{3}}/\\d{{4}}:\\d\\d:\\d\\d:\\d\\d [+-]\\d{{4}}') THEN epoch_ms(try_strptime(v, '%d/%b/%Y:%H:%M:%S %z'))
  WHEN regexp_full_match(v, '\\d{{1,15}}') THEN CASE WHEN v::BIGINT < 100000000000 THEN v::BIGINT * 1000 ELSE v::BIGINT END END AS ms FROM n),
t AS (SELECT event_id, rec_no, name, CASE kind WHEN 'text' THEN v
  WHEN 'bool' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
  WHEN 'int' THEN CASE WHEN x = floor(x) THEN cast(cast(x AS HUGEINT) AS VARCHAR) END
  WHEN 'dec' THEN cast(cast(x AS DECIMAL(38, 3)) AS VARCHAR) WHEN 'time' THEN cast(ms AS VARCHAR) END AS value FROM p)
SELECT event_id, name AS attr_name, arg_max(value, rec_no) AS attr_value FROM t WHERE value IS NOT NULL GROUP BY 1, 2"""
SQL["p3_found"] = _CELLS

#: The catalogue's attributes and their types, in name order, as typed columns.
_ATTRIBUTES = (
    ("build_tag", "VARCHAR"), ("cache_hit", "BOOLEAN"), ("cpu_load", "DECIMAL(38, 3)"), ("deployed_at", "TIMESTAMP"), ("first_seen", "TIMESTAMP"), ("flag_set", "VARCHAR"),
    ("is_canary", "BOOLEAN"), ("payload_bytes", "DECIMAL(38, 0)"), ("queue_depth", "DECIMAL(38, 0)"), ("region_code", "VARCHAR"), ("retry_count", "DECIMAL(38, 0)"),
    ("sample_rate", "DECIMAL(38, 3)"), ("shard_no", "DECIMAL(38, 0)"), ("tenant_tier", "VARCHAR"),
)


def _typed(name: str, kind: str) -> str:
    cell = f"max(CASE WHEN attr_name = '{name}' THEN attr_value END)"
    return f"epoch_ms({cell}::BIGINT) AS {name}" if kind == "TIMESTAMP" else f"cast({cell} AS {kind}) AS {name}"


SQL["p3_wide"] = f"SELECT event_id, {', '.join(_typed(*a) for a in _ATTRIBUTES)} FROM ({_CELLS}) GROUP BY event_id"

_FIELD = r'("([^"]|"")*"|[^",]*)'
_NAMES = ("timestamp", "level", "service", "ipAddress", "httpMethod", "endpoint", "statusCode", "responseTime", "requestId", "userId", "message")


def _json(name: str) -> str:
    """A member as text: strings as they are, numbers and booleans as written, objects and lists empty, null if absent."""
    at = f"json_extract(j, '$.{name}')"
    return f"CASE json_type({at}) WHEN 'VARCHAR' THEN json_extract_string(j, '$.{name}') WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN '' WHEN 'ARRAY' THEN '' ELSE cast({at} AS VARCHAR) END"


def _number(name: str, i: int) -> str:
    """A whole number of either kind of record; 0 if a JSON record leaves it out, null if it is none."""
    at = f"json_extract(j, '$.{name}')"
    return f"""CASE WHEN k <> 'jsonl' THEN CASE WHEN regexp_full_match(f[{i}], '[+-]?\\d{{1,38}}') THEN try_cast(f[{i}] AS HUGEINT) END
  WHEN coalesce(json_type({at}), 'NULL') = 'NULL' THEN 0 WHEN json_type({at}) IN ('UBIGINT', 'BIGINT') THEN try_cast(cast({at} AS VARCHAR) AS HUGEINT) END"""


_OTHERS = ", ".join(f"'{n}'" for n in _NAMES)
_IMPORT = f"""
WITH r AS (SELECT row_id, batch, row_no, regexp_replace(coalesce(raw_message, ''), '^\\s+|\\s+$', '', 'g') AS t,
  CASE WHEN suffix(batch, '.txt') THEN 'txt' WHEN suffix(batch, '.csv') THEN 'csv' WHEN suffix(batch, '.jsonl') THEN 'jsonl' END AS k FROM import_rows),
o AS (SELECT *, CASE WHEN k = 'jsonl' AND json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t::JSON END END AS j,
  k = 'csv' AND NOT regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*') AS torn FROM r),
p AS (SELECT *, CASE WHEN k = 'txt' THEN string_split(t, ' | ')
  WHEN k = 'csv' AND NOT torn THEN list_transform(regexp_extract_all(',' || t, '(?s),{_FIELD}', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END)
  WHEN j IS NOT NULL THEN [{", ".join(_json(n) for n in _NAMES)}] END AS f FROM o),
v AS (SELECT *, CASE WHEN (k <> 'jsonl' OR json_type(json_extract(j, '$.timestamp')) = 'VARCHAR') AND regexp_full_match(f[1], '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?Z')
  THEN try_strptime(f[1][1:19], '%Y-%m-%dT%H:%M:%S') END AS inst, upper(trim(f[2])) AS lv, upper(trim(f[5])) AS me, {_number("statusCode", 7)} AS st, {_number("responseTime", 8)} AS la FROM p),
d AS (SELECT *, CASE WHEN k IS NULL THEN 'format' WHEN k = 'jsonl' AND j IS NULL THEN 'json' WHEN torn THEN 'quoting' WHEN len(f) <> 11 THEN 'columns' WHEN inst IS NULL THEN 'timestamp'
  WHEN (k <> 'jsonl' OR lv IS NOT NULL) AND lv NOT IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL') THEN 'level'
  WHEN (k <> 'jsonl' OR me IS NOT NULL) AND me NOT IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH') THEN 'method'
  WHEN st IS NULL OR NOT (st = 0 OR st BETWEEN 100 AND 599) THEN 'status' WHEN la IS NULL OR NOT la BETWEEN 0 AND 9223372036854775807 THEN 'latency'
  WHEN trim(coalesce(f[11], ''), E' \t\n\r') = '' THEN 'message' END AS reason FROM v)"""
SQL["p5_found"] = f"{_IMPORT} SELECT row_id, reason FROM d WHERE reason IS NOT NULL"
SQL["p5_report"] = f"{_IMPORT} SELECT batch, count(*) AS rows, count(reason) AS rejected, count(reason) / count(*) AS reject_share FROM d GROUP BY batch"
SQL["p5_loaded"] = f"""{_IMPORT}
SELECT row_id, batch, row_no, inst + to_microseconds(cast(rpad(regexp_extract(f[1], '\\.(\\d{{1,6}})', 1), 6, '0') AS BIGINT)) AS ts, lv AS level, f[3] AS service, f[4] AS ip, me AS http_method,
  f[6] AS endpoint, cast(st AS INTEGER) AS status, cast(la AS BIGINT) AS response_ms, f[9] AS request_id, nullif(f[10], '-') AS user_id, f[11] AS message,
  CASE WHEN len(list_filter(json_keys(j), lambda x: x NOT IN ({_OTHERS}))) > 0 THEN '{{' || list_aggregate(list_transform(list_sort(list_filter(json_keys(j), lambda x: x NOT IN ({_OTHERS}))),
    lambda x: '"' || x || '": ' || cast(json_extract(j, '$."' || x || '"') AS VARCHAR)), 'string_agg', ', ') || '}}' END AS attributes
FROM d WHERE reason IS NULL"""


def _unwrapped(v: str) -> str:
    """JSON text inside a string as the value it denotes."""
    text = f"json_extract_string({v}, '$')"
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({text}, '^\\s*[\\[{{{{]') AND json_valid({text}) THEN {text}::JSON ELSE {v} END".replace("{{", "{")


def _kids(name: str, above: str, member: str, labels: tuple[str, ...]) -> str:
    """CTEs of a relation's children: name(session_id, seq, path, parent_key, child_key, v), one per element of ``member``."""
    own = " OR ".join(f"json_exists(u, '$.{x}')" for x in labels) or "true"
    one = [f"coalesce(CASE WHEN json_exists(v, '$.{x}') THEN coalesce(json_extract_string(v, '$.{x}'), '') END, k, '')" for x in labels]
    key = " || '>' || ".join(one) if one else "json_extract_string(v, '$')"
    return f"""
{name}_u AS (SELECT session_id, seq, path, op, {_unwrapped(member)} AS u FROM {above}),
{name}_l AS (SELECT *, CASE json_type(u) WHEN 'ARRAY' THEN list_transform(json_extract(u, '$[*]'), lambda x: struct_pack(k := NULL::VARCHAR, v := x))
  WHEN 'OBJECT' THEN CASE WHEN {own} THEN [struct_pack(k := NULL::VARCHAR, v := u)] ELSE list_transform(json_keys(u), lambda x: struct_pack(k := x, v := json_extract(u, '$."' || x || '"'))) END
  WHEN 'NULL' THEN [] ELSE CASE WHEN u::VARCHAR <> '""' THEN [struct_pack(k := NULL::VARCHAR, v := u)] END END AS l FROM {name}_u WHERE u IS NOT NULL),
{name}_e AS (SELECT session_id, seq, path, op, generate_subscripts(l, 1) AS o, unnest(l, recursive := true) FROM {name}_l),
{name}_v AS (SELECT session_id, seq, path, op, o, k, {_unwrapped("v")} AS v FROM {name}_e),
{name}_k AS (SELECT session_id, seq, path AS parent_key, op AS above, op || '/{name}' || lpad(o::VARCHAR, 9, '0') AS op, k, CASE WHEN json_type(v) = 'OBJECT' THEN {key} ELSE json_extract_string(v, '$') END AS child_key, v
  FROM {name}_v WHERE json_type(v) <> 'NULL'),
{name} AS (SELECT *, CASE WHEN parent_key = '' THEN child_key ELSE parent_key || '/' || child_key END AS path FROM {name}_k)"""


_FRAMES = f"""
WITH readable AS (SELECT session_id, seq, frame_id, payload::JSON AS j FROM sim_frames WHERE CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
frame AS (SELECT session_id, seq, '' AS path, '' AS op, arg_min(j, frame_id) AS v FROM readable GROUP BY session_id, seq),
topology AS (SELECT session_id, seq, path, op, {_unwrapped("json_extract(v, '$.topology')")} AS v FROM frame),
{_kids("health", "frame", "json_extract(v, '$.health')", ("service",))}, {_kids("incident", "frame", "json_extract(v, '$.incidents')", ("id",))},
{_kids("node", "topology", "json_extract(v, '$.nodes')", ("id",))}, {_kids("edge", "topology", "json_extract(v, '$.edges')", ("source", "target"))},
{_kids("evidence", "incident", "json_extract(v, '$.evidence')", ("algorithm",))}, {_kids("reference", "evidence", "json_extract(v, '$.references')", ())}"""
_RELS = ("health", "incident", "evidence", "reference", "node", "edge")
SQL["p2_found"] = _FRAMES + " UNION ALL ".join(f"\nSELECT '{r}' AS rel, session_id, seq, parent_key, child_key FROM {r}" for r in _RELS)


def _identity(name: str, label: str, inner: tuple[str, ...] = (), kids: tuple[str, ...] = ()) -> str:
    """CTE of identities: an object's own members in order of name, a map's key among them, then the identities of its children."""
    less = ", ".join(f"'{x}'" for x in inner) or "''"
    own = f"list_transform(list_filter(json_keys(v), lambda x: x NOT IN ({less})), lambda x: '\"' || x || '\":' || json_extract(v, '$.\"' || x || '\"')::VARCHAR)"
    keyed = f"CASE WHEN k IS NOT NULL AND NOT json_exists(v, '$.{label}') THEN ['\"{label}\":\"' || k || '\"'] ELSE [] END" if label else "[]"
    below = " || ".join(f"coalesce((SELECT string_agg(body, ';' ORDER BY op) FROM {k}_i c WHERE c.session_id = p.session_id AND c.seq = p.seq AND c.above = p.op), '')" for k in kids) or "''"
    return f"""
{name}_i AS (SELECT session_id, seq, above, op, CASE WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(list_concat({own}, {keyed})), ',') ELSE v::VARCHAR END || '|' || {below} AS body FROM {name} p)"""


_IDENTITIES = ", ".join(
    (
        _identity("reference", ""), _identity("evidence", "algorithm", ("references",), ("reference",)), _identity("incident", "id", ("evidence",), ("evidence",)),
        _identity("health", "service"), _identity("node", "id"), _identity("edge", ""),
        "record AS (SELECT session_id, seq, NULL AS above, '' AS op, NULL::VARCHAR AS k, v FROM frame)", _identity("record", "", ("health", "incidents", "topology"), ("health", "incident", "node", "edge")),
    )
)
SQL["p2_objects"] = f"{_FRAMES}, {_IDENTITIES}" + " UNION ALL ".join(
    f"\nSELECT '{r}' AS rel, count(DISTINCT body) AS objects, count(*) AS occurrences FROM {r}_i HAVING count(*) > 0" for r in (*_RELS, "record")
)

#: The layouts of the given lines as expressions; the query finds them in the lines instead.
_TIME = r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?|\d\d/[A-Za-z]{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4}|\d{13})"
_LAYOUTS = (
    (rf"^{_TIME} +([A-Za-z]+) +\[[^\]]*\] +(\S+) - ?(.*)$", "ts", "lv", "co", "msg"),
    (rf"^\[{_TIME}\]\[ *([A-Za-z]+) *\]\[([^\]]*)\](.*)$", "ts", "lv", "co", "msg"),
    (rf"^{_TIME}\t([A-Za-z]+)\t([^\t]*)\t(.*)$", "ts", "lv", "co", "msg"),
    (rf"^{_TIME} +([^\s\[]+)\[\d+\] +([A-Za-z]+): ?(.*)$", "ts", "co", "lv", "msg"),
    (rf"^{_TIME} \| ([A-Za-z]+) \| (.*?) \| (?:.*? \| ){{{{7}}}}(.*)$".replace("{{{{", "{").replace("}}}}", "}").replace("{{7}}", "{7}"), "ts", "lv", "co", "msg"),
    (rf"^([A-Z]) {_TIME} +([^\s\]]+)\](.*)$", "lv", "ts", "co", "msg"),
)


def _level(v: str) -> str:
    words = {
        "TRACE": ("trace", "trc", "finest"), "DEBUG": ("debug", "dbg"), "INFO": ("info", "inf", "information"), "WARN": ("warn", "wrn", "warning"),
        "ERROR": ("error", "err", "severe"), "FATAL": ("fatal", "ftl", "critical", "crit"),
    }
    cases = " ".join(f"WHEN lower({v}) IN ({', '.join(repr(w) for w in ws)}) OR {v} = '{name[0]}' OR (regexp_full_match({v}, '\\d+') AND {v}::INT BETWEEN {n} AND {n + 3}) THEN '{name}'"
                     for (name, ws), n in zip(words.items(), (1, 5, 9, 13, 17, 21)))
    return f"CASE {cases} END"


def _instant(v: str) -> str:
    iso = f"replace(replace({v}, ',', '.'), ' ', 'T')"
    return f"""CASE WHEN regexp_full_match({v}, '\\d{{12,13}}') THEN {v}::BIGINT WHEN regexp_full_match({v}, '\\d{{9,10}}') THEN {v}::BIGINT * 1000
  WHEN {v} LIKE '__/___/%' THEN epoch_ms(try_strptime({v}, '%d/%b/%Y:%H:%M:%S %z'))
  ELSE epoch_ms(try_cast(CASE WHEN regexp_matches({v}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {iso} ELSE {iso} || 'Z' END AS TIMESTAMPTZ)) END"""


def _pick(j: str, keys: tuple[str, ...]) -> str:
    at = [f"CASE WHEN json_type(json_extract({j}, '$.\"{k}\"')) NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN json_extract_string({j}, '$.\"{k}\"') END" for k in keys]
    return f"coalesce({', '.join(at)})"


_TS_KEYS, _LV_KEYS = ("timestamp", "ts", "time", "@timestamp", "datetime"), ("level", "lvl", "severity", "severityNumber", "loglevel")
_CO_KEYS, _MSG_KEYS = ("service", "component", "app", "logger", "source"), ("message", "msg")
_OBJECT_FIELDS = f"{_pick('j', _TS_KEYS)} AS ts, {_pick('j', _LV_KEYS)} AS lv, {_pick('j', _CO_KEYS)} AS co, {_pick('j', _MSG_KEYS)} AS msg"
_HEADS = " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN struct_pack(ts := regexp_extract(t, '{p}', {n.index('ts') + 1}), lv := regexp_extract(t, '{p}', {n.index('lv') + 1}), "
    f"co := regexp_extract(t, '{p}', {n.index('co') + 1}), msg := regexp_extract(t, '{p}', {n.index('msg') + 1}))"
    for p, *n in _LAYOUTS
)
_PAIR = r"""((?:"(?:[^"\\]|\\.)*"|[^ "]*))"""


def _value(keys: tuple[str, ...]) -> str:
    """A member of a key=value line, without its quotes and escapes."""
    v = f"regexp_extract(t, '(?:^| )(?:{'|'.join(k for k in keys if k != '@timestamp')})={_PAIR}', 1)"
    return f"CASE WHEN {v} LIKE '\"%' THEN regexp_replace(replace(replace(({v})[2:-2], '\\n', chr(10)), '\\t', chr(9)), '\\\\(.)', '\\1', 'g') ELSE nullif({v}, '') END"


SQL["p4_found"] = f"""
WITH l AS (SELECT stream, line_no, raw_message AS raw, regexp_replace(rtrim(coalesce(raw_message, ''), E'\\r\\n'), chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS t FROM raw_lines WHERE stream IS NOT NULL AND line_no IS NOT NULL),
h AS (SELECT stream, line_no, raw, t, regexp_full_match(t, '\\s*') AS blank, t = '{{' OR regexp_full_match(t, '\\{{\\s*') AS opens, regexp_full_match(t, '\\}}\\s*') AS closes,
  CASE {_HEADS} WHEN regexp_matches(t, '^(?:{"|".join(_TS_KEYS + _LV_KEYS + _CO_KEYS + _MSG_KEYS)})=') THEN struct_pack(ts := {_value(_TS_KEYS)}, lv := {_value(_LV_KEYS)}, co := {_value(_CO_KEYS)}, msg := {_value(_MSG_KEYS)}) END AS f,
  CASE WHEN t LIKE '{{%' AND json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN t::JSON END END AS j FROM l),
o AS (SELECT *, {_OBJECT_FIELDS} FROM h),
q AS (SELECT stream, line_no, raw, t, blank, opens, closes, CASE WHEN j IS NOT NULL THEN ts ELSE f.ts END AS ts, CASE WHEN j IS NOT NULL THEN lv ELSE f.lv END AS lv, CASE WHEN j IS NOT NULL THEN co ELSE f.co END AS co,
  CASE WHEN j IS NOT NULL THEN msg ELSE f.msg END AS msg, j IS NOT NULL AS object FROM o),
k AS (SELECT *, {_instant("ts")} AS ms, {_level("lv")} AS level FROM q),
m AS (SELECT *, CASE WHEN ms IS NOT NULL AND msg IS NOT NULL AND (object OR level IS NOT NULL) THEN 1 WHEN opens THEN 2 ELSE 0 END AS kind FROM k),
w AS (SELECT *, max(CASE WHEN kind > 0 THEN line_no END) OVER a AS owner, max(CASE WHEN closes THEN line_no END) OVER (PARTITION BY stream ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM m
  WINDOW a AS (PARTITION BY stream ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
x AS (SELECT w.stream, w.owner, string_agg(w.t, chr(10) ORDER BY w.line_no) AS body, list(w.t ORDER BY w.line_no) AS parts FROM w JOIN m b ON b.stream = w.stream AND b.line_no = w.owner AND b.kind = 2
  WHERE coalesce(w.closed, -1) < w.owner GROUP BY 1, 2),
y AS (SELECT stream, owner, body, list_filter(list_transform(parts[2:], lambda p: regexp_extract(p, '^(\\s*)"((?:[^"\\\\]|\\\\.)*)"\\s*:\\s*(.*?),?\\s*$', ['pad', 'key', 'value'])), lambda p: p.key <> '') AS members FROM x),
z AS (SELECT stream, owner, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN body::JSON END
  ELSE ('{{' || coalesce(array_to_string(list_transform(list_reverse(list_filter(members, lambda p: p.pad = members[1].pad AND json_valid(p.value))), lambda p: '"' || p.key || '": ' || p.value), ','), '') || '}}')::JSON END AS j FROM y),
v AS (SELECT stream, owner, {_OBJECT_FIELDS} FROM z),
e AS (SELECT stream, line_no, ms AS ts_ms, level, co AS component, msg FROM m WHERE kind = 1
  UNION ALL SELECT stream, owner, {_instant("ts")}, {_level("lv")}, co, msg FROM v WHERE msg IS NOT NULL AND {_instant("ts")} IS NOT NULL),
s AS (SELECT m.stream, m.line_no, m.blank, max(e.line_no) OVER (PARTITION BY m.stream ORDER BY m.line_no ROWS UNBOUNDED PRECEDING) AS entry FROM m LEFT JOIN e ON e.stream = m.stream AND e.line_no = m.line_no)
SELECT e.stream, e.line_no AS first_line_no, max(s.line_no) FILTER (NOT blank) AS last_line_no, ts_ms, level, nullif(trim(component), '') AS component, trim(msg, E' \\t\\n\\r') AS msg
FROM e JOIN s ON s.stream = e.stream AND s.entry = e.line_no GROUP BY ALL"""
