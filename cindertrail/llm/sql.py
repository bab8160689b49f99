"""Oracle SQL (DuckDB) of the queries of problems 6 to 8."""

from __future__ import annotations

SQL: dict[str, str] = {}

_RANK = """
WITH v AS (SELECT service, endpoint, response_ms FROM log_events WHERE service IS NOT NULL AND endpoint IS NOT NULL AND response_ms > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY service, endpoint ORDER BY response_ms) AS rn, count(*) OVER (PARTITION BY service, endpoint) AS n FROM v)
SELECT service, endpoint, max(n) AS n, {picks} FROM r GROUP BY service, endpoint"""


def _pick(num: int, name: str) -> str:
    return f"max(CASE WHEN rn = (n * {num} + 99) // 100 THEN response_ms END) AS {name}"


SQL["p6_percentiles"] = _RANK.format(picks=", ".join(_pick(n, f"p{n}") for n in (50, 90, 95, 99)))
SQL["p6_merged_days"] = SQL["p6_percentiles"]
SQL["p6_bounded"] = f"SELECT service, endpoint, n, true AS within FROM ({SQL['p6_percentiles']})"
SQL["p6_found"] = f"SELECT service, endpoint FROM ({_RANK.format(picks=', '.join(_pick(n, f'p{n}') for n in (50, 95)))}) WHERE n >= 20 AND p95 >= 10 * p50"

_RUNS = """
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY ts, level, service, host, ip, http_method, endpoint, status, response_ms,
                               request_id, user_id, message, trace_id, source ORDER BY id) AS copy
  FROM log_events WHERE service IS NOT NULL AND ts IS NOT NULL),
e AS (
  SELECT service, id, ts, trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '[\\s\\x{A0}.!]+$', ''),
         '[^\\s\\x{A0}]*\\d[^\\s\\x{A0}]*', chr(1), 'g'), '[\\s\\x{A0}]+', ' ', 'g')) AS m
  FROM c WHERE copy = 1),
l AS (SELECT *, CASE WHEN m IS NOT DISTINCT FROM lag(m) OVER w AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS opens
      FROM e WINDOW w AS (PARTITION BY service ORDER BY ts, id)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY service ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT service, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id, count(*) AS events,
       epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
FROM g GROUP BY service, run"""
SQL["p7_runs"] = _RUNS
SQL["p7_found"] = f"SELECT service, first_id, last_id FROM ({_RUNS}) WHERE events >= 3"

_GRAMS = """
SELECT {key}, p, list_aggregate(w[p:p + 12], 'string_agg', ' ') AS g
FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS p
      FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 13)"""
_LEAKS = f"""
WITH d AS ({_GRAMS.format(key='doc_id', table='documents')}),
i AS (SELECT DISTINCT item_id, g FROM ({_GRAMS.format(key='item_id', table='eval_items')}))
SELECT doc_id, item_id, count(DISTINCT p) AS windows, min(p) - 1 AS first_word, max(p) + 11 AS last_word
FROM d JOIN i USING (g) GROUP BY doc_id, item_id"""
SQL["p8_leaks"] = _LEAKS
SQL["p8_found"] = f"SELECT doc_id, item_id FROM ({_LEAKS})"

#: Sizes in characters: which sources fall short doesn't hang on the unit.
SQL["p9_found"] = """
WITH d AS (SELECT lower(trim(source, E' \\t\\n\\r')) AS source, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT source, sum(n) AS size FROM d GROUP BY 1)
SELECT t.source FROM (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets) t LEFT JOIN s ON s.source = t.source
WHERE coalesce(size, 0) * max_repeats < target_share * (SELECT sum(n) FROM d)"""

_UNIT_WORDS = "('ms', 's', 'sec', 'second', 'seconds', 'minute', 'minutes', 'min', 'hour', 'hours', 'day', 'days', 'week', 'weeks', 'beats', 'percent', 'bytes', 'kb', 'mb', 'gb')"


def _templates(key: str, table: str) -> str:
    """key, p, w, t: the words of a text and the template of every window of 13, its own words where it has under four words of wording."""
    return f"""
SELECT {key}, p, w, CASE WHEN len(list_filter(list_zip(w[p:p + 12], s[p:p + 12]), lambda x: x[1] = x[2])) >= 4 THEN 'template ' || list_aggregate(s[p:p + 12], 'string_agg', ' ')
  ELSE 'words ' || list_aggregate(w[p:p + 12], 'string_agg', ' ') END AS t
FROM (SELECT {key}, w, s, unnest(range(1, len(w) - 11)) AS p FROM (
  SELECT {key}, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '\\p{{Nd}}') THEN '<num>' WHEN x IN {_UNIT_WORDS} THEN '<unit>' WHEN list_contains(kept, x) THEN x ELSE '<name>' END) AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL), wording WHERE len(w) >= 13))"""


_CLASSES = f"""
WITH wording AS (SELECT list(x) AS kept FROM (SELECT x FROM (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS x FROM eval_items)
  GROUP BY x HAVING count(*) > 8)),
i AS ({_templates("item_id", "eval_items")}), m AS (SELECT item_id, any_value(w) AS w, list(t ORDER BY p) AS ts FROM i GROUP BY item_id), k AS (SELECT ts, min(item_id) AS class_id FROM m GROUP BY ts)"""
SQL["p8_classes"] = f"{_CLASSES} SELECT item_id, class_id FROM m JOIN k USING (ts)"
_FIRST = "list_transform({0}, lambda word: list_position({0}, word))"
SQL["p8_variants"] = f"""{_CLASSES},
c AS (SELECT item_id, class_id, w AS iw FROM m JOIN k USING (ts)), sh AS (SELECT class_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS item_pos, len(ts) AS whole FROM k),
d AS ({_templates("doc_id", "documents")}),
h AS (SELECT DISTINCT doc_id, class_id, whole, item_pos, p - item_pos AS shift FROM d JOIN sh USING (t)),
n AS (SELECT *, item_pos - row_number() OVER (PARTITION BY doc_id, class_id, shift ORDER BY item_pos) AS island FROM h),
r AS (SELECT doc_id, class_id, shift, any_value(whole) AS whole, count(*) AS windows, min(item_pos) AS a, max(item_pos) + 12 AS z FROM n GROUP BY doc_id, class_id, shift, island),
dw AS (SELECT doc_id, any_value(w) AS w FROM d GROUP BY doc_id),
b AS (SELECT r.*, item_id, w[a + shift:z + shift] AS x, iw[a:z] AS y FROM r JOIN dw USING (doc_id) JOIN c USING (class_id)),
g AS (SELECT doc_id, class_id, item_id, sum(windows) AS windows, max(windows / whole) AS share FROM b WHERE {_FIRST.format("x")} = {_FIRST.format("y")} GROUP BY doc_id, class_id, item_id),
e AS (SELECT doc_id, class_id, count(*) AS exact FROM ({SQL["p8_found"]}) JOIN c USING (item_id) GROUP BY doc_id, class_id)
SELECT doc_id, class_id, cast(max(windows) AS BIGINT) AS windows, max(share) AS share, count(*) AS links, coalesce(any_value(exact), 0) AS exact FROM g LEFT JOIN e USING (doc_id, class_id) GROUP BY doc_id, class_id"""
