"""Oracle SQL (DuckDB) of the log queries."""

from __future__ import annotations

FROM_MS, TO_MS = 1_646_870_400_000, 1_646_956_800_000

BAD = "coalesce(level IN ('ERROR', 'FATAL'), false)"
TEXT = "coalesce(level, '') || ' ' || coalesce(service, '') || ' ' || coalesce(endpoint, '') || ' ' || coalesce(message, '')"
COUNTS = f"count(*) AS events, count(*) FILTER ({BAD}) AS errors, count(*) FILTER (level = 'WARN') AS warnings, 100.0 * count(*) FILTER ({BAD}) / count(*) AS error_rate_pct"
TEMPLATE = """array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(message, '\\s+', ' ', 'g')), ' '),
  lambda t: CASE WHEN regexp_matches(t, '[\\p{Nd}#{}$]') OR (length(t) >= 8 AND regexp_matches(t, '^[0-9a-fA-F-]+$')) THEN '<*>'
                 ELSE regexp_replace(t, '[^\\p{L}\\p{N}._-]', '', 'g') END), lambda t: t <> ''), ' ')"""
HEX = "service = 'billing'"


def _disc(p: float) -> str:
    return f"cast(quantile_disc(response_ms, {p}) AS BIGINT)"


def _windows(n: int) -> str:
    return f"""
WITH e AS (SELECT epoch_ms(ts) AS ms, {BAD} AS bad FROM log_events WHERE ts IS NOT NULL),
s AS (SELECT min(ms) AS lo, cast(ceil((max(ms) - min(ms) + 1) / {n}.0) AS BIGINT) AS width FROM e),
f AS (SELECT least({n - 1}, (ms - lo) // width) AS bucket, count(*) AS n, count(*) FILTER (bad) AS e FROM e, s GROUP BY 1)
SELECT b AS bucket, lo + b * width AS start_ms, lo + b * width + width - 1 AS end_ms, coalesce(n, 0) AS events, coalesce(e, 0) AS errors
FROM s, range({n}) r(b) LEFT JOIN f ON bucket = b"""


def _snippet(pattern: str) -> str:
    p = pattern.lower()
    at = f"strpos(lower(t), '{p}')"
    return f"""CASE WHEN {at} > 0 THEN (CASE WHEN greatest(1, {at} - 30) > 1 THEN '…' ELSE '' END)
      || substring(t, greatest(1, {at} - 30), least(length(t), {at} + {len(p) - 1 + 40}) - greatest(1, {at} - 30) + 1)
      || (CASE WHEN least(length(t), {at} + {len(p) - 1 + 40}) < length(t) THEN '…' ELSE '' END)
      ELSE trim(substring(trim(t), 1, 140)) END"""


def _overlaps(text: str, p: str) -> str:
    return f"(SELECT count(*) FROM range(1, length({text}) + 1) r(i) WHERE substring({text}, i, {len(p)}) = '{p}')"


EDGES = """
SELECT source, target, count(*) AS weight FROM (
  SELECT service AS target, lag(service) OVER (PARTITION BY request_id ORDER BY epoch_ms(ts), id) AS source
  FROM log_events WHERE request_id IS NOT NULL AND service IS NOT NULL)
WHERE source IS NOT NULL AND source <> target GROUP BY 1, 2"""


def _reach(edge: str, origin: str) -> str:
    return f"""
WITH RECURSIVE e AS ({edge}), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
w AS (SELECT x AS origin, x AS service, 0 AS hops FROM n
      UNION SELECT origin, b, hops + 1 FROM w JOIN e ON a = service WHERE hops < 20)
SELECT origin, service, min(hops) AS hops FROM w WHERE origin = '{origin}' GROUP BY 1, 2"""


INCIDENTS = f"""
WITH e AS (SELECT id, epoch_ms(ts) AS ms, coalesce(service, '?') AS service, message, {TEMPLATE} AS template FROM log_events WHERE {BAD} AND ts IS NOT NULL),
s AS (SELECT min(ms) AS origin, max(ms) AS latest, count(*) AS total,
      least(5000, greatest(1, cast(ceil(greatest(300000, max(ms) - min(ms) + 1) / 300000.0) AS BIGINT))) AS windows FROM e),
t AS (SELECT *, total / windows AS baseline, greatest(3, cast(ceil(3.0 * (total / windows)) AS BIGINT)) AS threshold FROM s),
h AS (SELECT least(windows - 1, (ms - origin) // 300000) AS slot, count(*) AS n FROM e, t GROUP BY 1),
hot AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS island FROM h, t WHERE n >= threshold),
sp AS (SELECT min(slot) AS a, max(slot) AS b FROM hot GROUP BY island),
inc AS (SELECT origin + a * 300000 AS start_ms, least(latest, origin + (b + 1) * 300000) AS end_ms,
        threshold, baseline FROM sp, t),
m AS (SELECT start_ms, e.* FROM e JOIN inc ON ms >= start_ms AND ms < end_ms),
sv AS (SELECT start_ms, string_agg(service, ',' ORDER BY r) AS services FROM (
         SELECT start_ms, service, row_number() OVER (PARTITION BY start_ms ORDER BY count(*) DESC, min(id)) AS r FROM m GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1),
tp AS (SELECT start_ms, template AS pattern FROM (
         SELECT start_ms, template, row_number() OVER (PARTITION BY start_ms ORDER BY count(*) DESC, min(id)) AS r FROM m WHERE template IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
SELECT row_number() OVER (ORDER BY start_ms) AS incident_id, start_ms, end_ms, threshold, baseline, count(*) AS errors, any_value(services) AS services, any_value(pattern) AS pattern
FROM inc JOIN m USING (start_ms) LEFT JOIN sv USING (start_ms) LEFT JOIN tp USING (start_ms)
GROUP BY start_ms, end_ms, threshold, baseline ORDER BY errors DESC, incident_id LIMIT 200"""


def _top(dim: str, n: int) -> str:
    return f"SELECT {dim} AS key, count(*) AS events FROM log_events WHERE {dim} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT {n}"


BUCKETS = f"""SELECT service, epoch_ms(ts) // 3600000 AS bucket, count(*) FILTER ({BAD}) AS errors,
  avg(CASE WHEN response_ms > 0 THEN response_ms END) AS avg_ms FROM log_events WHERE service IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2"""

SQL: dict[str, str] = {
    "severity_distribution": """
SELECT l.level, ord, count(e.id) AS events FROM (VALUES ('TRACE', 0), ('DEBUG', 1), ('INFO', 2), ('WARN', 3), ('ERROR', 4), ('FATAL', 5)) l(level, ord)
LEFT JOIN log_events e ON e.level = l.level GROUP BY 1, 2""",
    "frequency_analysis": """
SELECT 'level' AS dimension, level AS key, count(*) AS events FROM log_events WHERE level IS NOT NULL GROUP BY 2
UNION ALL SELECT 'service', service, count(*) FROM log_events WHERE service IS NOT NULL GROUP BY 2
UNION ALL SELECT 'status', cast(status AS VARCHAR), count(*) FROM log_events WHERE status <> 0 GROUP BY 2
UNION ALL SELECT 'endpoint', endpoint, count(*) FROM log_events WHERE endpoint IS NOT NULL GROUP BY 2""",
    "response_summary": """
SELECT count(*) AS events, cast(sum(coalesce(response_ms, 0)) AS BIGINT) AS sum_ms, min(coalesce(response_ms, 0)) AS min_ms, max(coalesce(response_ms, 0)) AS max_ms,
       avg(coalesce(response_ms, 0)) AS avg_ms FROM log_events""",
    "dataset_stats": f"""
SELECT count(*) AS total_logs, count(*) FILTER ({BAD}) AS errors, count(*) FILTER (level = 'WARN') AS warnings, count(DISTINCT service) AS services,
       count(DISTINCT ip) AS unique_ips, avg(CASE WHEN response_ms > 0 THEN response_ms END) AS avg_response_ms,
       count(*) / ((max(epoch_ms(ts)) - min(epoch_ms(ts))) / 60000.0) AS requests_per_minute FROM log_events""",
    "service_rollup": f"SELECT coalesce(service, '(unknown)') AS name, {COUNTS}, count(DISTINCT host) AS hosts, max(epoch_ms(ts)) AS latest_ms FROM log_events GROUP BY 1",
    "service_rollup_one": f"SELECT service AS name, {COUNTS}, count(DISTINCT host) AS hosts, max(epoch_ms(ts)) AS latest_ms FROM log_events WHERE {HEX} GROUP BY 1",
    "service_severity": "SELECT coalesce(service, '(unknown)') AS name, level, count(*) AS events FROM log_events WHERE level IS NOT NULL GROUP BY 1, 2",
    "host_rollup": f"SELECT coalesce(host, '(no host)') AS host, {COUNTS} FROM log_events GROUP BY 1",
    "latency_percentiles": f"SELECT service, count(*) AS sampled, {_disc(0.5)} AS p50_ms, {_disc(0.95)} AS p95_ms, {_disc(0.99)} AS p99_ms FROM log_events WHERE response_ms > 0 GROUP BY 1",
    "http_stats": f"""
WITH h AS (SELECT * FROM log_events WHERE http_method IS NOT NULL OR coalesce(status, 0) <> 0),
l AS (SELECT {_disc(0.5)} AS p50, {_disc(0.95)} AS p95, max(response_ms) AS mx, count(*) AS n FROM h WHERE response_ms > 0)
SELECT 'status' AS section, cast(status AS VARCHAR) AS key, count(*) AS value FROM h WHERE status <> 0 GROUP BY 2
UNION ALL SELECT 'method', http_method, count(*) FROM h WHERE http_method IS NOT NULL GROUP BY 2
UNION ALL (SELECT 'endpoint', endpoint, count(*) FROM h WHERE endpoint IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 DESC LIMIT 10)
UNION ALL SELECT 'latency', 'p50', coalesce(p50, 0) FROM l UNION ALL SELECT 'latency', 'p95', coalesce(p95, 0) FROM l
UNION ALL SELECT 'latency', 'max', coalesce(mx, 0) FROM l UNION ALL SELECT 'latency', 'sampled', n FROM l""",
    "top_error": "SELECT message, count(*) AS events FROM log_events WHERE level = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "top_errors": "SELECT message, count(*) AS events FROM log_events WHERE level IN ('ERROR', 'WARN') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_k_service": _top("service", 5),
    "top_k_endpoint": _top("endpoint", 10),
    "top_k_level": _top("level", 10),
    "top_k_ip": _top("ip", 10),
    "histogram_source": "SELECT source AS key, count(*) AS events FROM log_events WHERE trim(source) <> '' GROUP BY 1",
    "distinct_services": "SELECT service, min(id) AS first_id FROM log_events WHERE service IS NOT NULL GROUP BY 1",
    "hour_weekday_heatmap": """
SELECT w AS weekday, h AS hour, coalesce(n, 0) AS events FROM range(7) a(w), range(24) b(h) LEFT JOIN (
  SELECT isodow(timezone('UTC', ts)) - 1 AS wd, hour(timezone('UTC', ts)) AS hr, count(*) AS n FROM log_events WHERE ts IS NOT NULL GROUP BY 1, 2) ON wd = w AND hr = h""",
    "time_windows": _windows(10),
    "timeline_buckets": _windows(24),
    "range_buckets": f"""
WITH f AS (SELECT least(23, (epoch_ms(ts) - {FROM_MS}) // 3600000) AS bucket, count(*) AS n, count(*) FILTER ({BAD}) AS e
           FROM log_events WHERE epoch_ms(ts) BETWEEN {FROM_MS} AND {TO_MS} GROUP BY 1)
SELECT b AS bucket, {FROM_MS} + b * 3600000 AS start_ms, {FROM_MS} + (b + 1) * 3600000 AS end_ms, coalesce(n, 0) AS events, coalesce(e, 0) AS errors
FROM range(24) r(b) LEFT JOIN f ON bucket = b""",
    "service_activity": f"""
WITH s AS (SELECT max(epoch_ms(ts)) + 1 - 86400000 AS lo FROM log_events),
f AS (SELECT (epoch_ms(ts) - lo) // 3600000 AS bucket, count(*) AS n, count(*) FILTER ({BAD}) AS e FROM log_events, s WHERE {HEX} AND epoch_ms(ts) >= lo GROUP BY 1)
SELECT b AS bucket, lo + b * 3600000 AS start_ms, coalesce(n, 0) AS events, coalesce(e, 0) AS errors FROM s, range(24) r(b) LEFT JOIN f ON bucket = b""",
    "recent_events": f"SELECT id, level, message FROM log_events WHERE {HEX} ORDER BY ts DESC NULLS LAST, id LIMIT 50",
    "recent_critical": f"SELECT id, level, service, message FROM log_events WHERE {BAD} ORDER BY ts DESC, id DESC LIMIT 12",
    "message_patterns": f"""
SELECT {TEMPLATE} AS template, count(*) AS count, min(id) AS first_id, arg_min(message, id) AS example, arg_min_null(level, id) AS level
FROM log_events WHERE message IS NOT NULL GROUP BY 1""",
    "pattern_examples": f"SELECT id, message FROM log_events WHERE {TEMPLATE} = 'reply sent with <*> bytes' ORDER BY id LIMIT 200",
    "search_structured": f"""
SELECT id, 0 AS matches, {_snippet('')} AS snippet FROM (SELECT *, {TEXT} AS t FROM log_events)
WHERE level IN ('ERROR', 'WARN') AND service = 'billing' AND status = 500""".replace("strpos(lower(t), '')", "0"),
    "search_phrase": f"""
SELECT id, {_overlaps('lower(t)', 'timed out after')} AS matches, {_snippet('timed out after')} AS snippet
FROM (SELECT *, {TEXT} AS t FROM log_events) WHERE contains(lower(t), 'timed out after')""",
    "search_time_range": f"SELECT id, service, message FROM log_events WHERE level = 'ERROR' AND epoch_ms(ts) >= {FROM_MS} AND epoch_ms(ts) < {TO_MS}",
    "search_total": f"""
SELECT count(*) AS rows, cast(sum({_overlaps('t', 'peer')}) AS BIGINT) AS hits FROM (SELECT lower({TEXT}) AS t FROM log_events WHERE level = 'WARN') WHERE contains(t, 'peer')""",
    "explore_page": "SELECT id, service FROM log_events WHERE level = 'ERROR' ORDER BY coalesce(service, ''), id LIMIT 50 OFFSET 50",
    "events_slice": "SELECT id, message FROM log_events ORDER BY id LIMIT 100 OFFSET 50",
    "event_by_id": "SELECT id, message FROM log_events WHERE id = 42",
    "typeahead": """
SELECT kind, value FROM (
  SELECT 0 AS ord, 'level' AS kind, level AS value, id FROM log_events UNION ALL SELECT 1, 'status', cast(nullif(status, 0) AS VARCHAR), id FROM log_events
  UNION ALL SELECT 2, 'service', service, id FROM log_events UNION ALL SELECT 3, 'host', host, id FROM log_events
  UNION ALL SELECT 4, 'source', source, id FROM log_events UNION ALL SELECT 5, 'endpoint', endpoint, id FROM log_events)
WHERE contains(lower(value), 'in') GROUP BY ord, kind, value ORDER BY ord, min(id), value LIMIT 20""",
    "did_you_mean": """
WITH m AS (SELECT message, min(id) AS first_id, levenshtein(message, 'reply sent wth 100 byts') AS distance, greatest(length(message), 23) AS longest
           FROM log_events WHERE message IS NOT NULL GROUP BY 1)
SELECT message, distance, cast(round(100.0 * (1 - distance / longest)) AS INTEGER) AS similarity FROM m
WHERE distance <= greatest(2, ceil(longest * 0.35)) ORDER BY distance, first_id LIMIT 1""",
    "fuzzy_lines": """
SELECT id, message AS line, levenshtein(message, 'reply sent with 100 bytes') AS distance FROM log_events
WHERE levenshtein(message, 'reply sent with 100 bytes') <= 2""",
    "token_search": f"""
SELECT id FROM (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws('$', coalesce(service, ''), coalesce(endpoint, ''), {TEXT})), '[ $/:{{}}|.@_\\-]+'), lambda x: length(x) >= 2) AS w FROM log_events)
WHERE list_contains(w, 'peer') AND list_contains(w, 'channel') AND list_contains(w, 'billing')""",
    "searchable_text": f"""
SELECT id, {TEXT} AS text, coalesce(CASE level WHEN 'TRACE' THEN 1 WHEN 'DEBUG' THEN 5 WHEN 'INFO' THEN 9 WHEN 'WARN' THEN 13 WHEN 'ERROR' THEN 17 WHEN 'FATAL' THEN 21 END, 0) AS severity
FROM log_events""",
    "service_dependencies": EDGES,
    "node_degrees": f"""
WITH e AS ({EDGES}) SELECT service, count(*) AS events, (SELECT count(*) FROM e WHERE target = service) AS in_degree,
  (SELECT count(*) FROM e WHERE source = service) AS out_degree FROM log_events WHERE service IS NOT NULL GROUP BY service""",
    "top_nodes": "SELECT service, count(*) AS events FROM log_events WHERE service IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 5",
    "reachability": _reach("SELECT caller AS a, callee AS b FROM service_calls", "edge-proxy"),
    "blast_radius": _reach("SELECT callee AS a, caller AS b FROM service_calls", "ledger-db"),
    "direct_dependents": "SELECT DISTINCT caller AS service FROM service_calls WHERE callee = 'ledger-db'",
    "incidents": INCIDENTS,
    "incident_evidence": f"SELECT incident_id, id, level FROM ({INCIDENTS}) i JOIN log_events ON epoch_ms(ts) >= start_ms AND epoch_ms(ts) < end_ms",
    "events_in_window": f"SELECT id, level FROM log_events WHERE epoch_ms(ts) >= {FROM_MS} AND epoch_ms(ts) < {TO_MS} ORDER BY id LIMIT 1000 OFFSET 10",
    "burst_readings": f"""
WITH b AS ({BUCKETS}), r AS (SELECT service, bucket, errors, coalesce(avg(errors) OVER (PARTITION BY service ORDER BY bucket ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) AS baseline FROM b),
q AS (SELECT *, CASE WHEN baseline > 0 THEN errors / baseline WHEN errors > 0 THEN 'infinity'::DOUBLE ELSE 0 END AS ratio FROM r)
SELECT *, errors >= 4 AND ratio >= 2.2 AS burst FROM q""",
    "latency_baseline": f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY bucket) AS i, count(*) OVER (PARTITION BY service) AS n FROM ({BUCKETS}) WHERE avg_ms IS NOT NULL)
SELECT service, count(*) AS buckets, sum(pow(0.85, n - i) * (CASE WHEN i = 1 THEN 1 ELSE 0.15 END) * avg_ms) AS baseline_ms FROM b GROUP BY 1""",
    "histogram_p95": """
WITH b AS (SELECT service, least(59, response_ms // 200) AS bin, count(*) AS n FROM log_events WHERE response_ms > 0 AND service IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY service) AS sampled FROM b)
SELECT service, cast(max(sampled) AS BIGINT) AS sampled, (min(bin) + 1) * 200 AS p95_ms FROM c WHERE upto >= ceil(sampled * 0.95) GROUP BY 1""",
    "last_n": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, id DESC) AS k FROM log_events WHERE service IS NOT NULL AND ts IS NOT NULL)
SELECT service, count(*) AS events, count(*) FILTER ({BAD}) AS errors, coalesce(avg(response_ms), 0) AS avg_ms, 100.0 * count(*) FILTER ({BAD}) / count(*) AS error_pct
FROM r WHERE k <= 500 GROUP BY 1""",
    "replay_batches": """
SELECT batch, count(*) AS events, arg_min(id, (ms, id)) AS first_id, arg_max(id, (ms, id)) AS last_id FROM (
  SELECT id, epoch_ms(ts) AS ms, 1 + (row_number() OVER (ORDER BY epoch_ms(ts), id) - 1) // 200 AS batch FROM log_events WHERE ts IS NOT NULL) GROUP BY 1""",
    "prefix_scan_inclusive": "SELECT id, cast(sum(coalesce(response_ms, 0)) OVER (ORDER BY id) AS BIGINT) AS scan FROM log_events",
    "prefix_scan_exclusive": "SELECT id, cast(sum(coalesce(response_ms, 0)) OVER (ORDER BY id) - coalesce(response_ms, 0) AS BIGINT) AS scan FROM log_events",
    "reduce_sum": "SELECT cast(sum(response_ms) AS BIGINT) AS result FROM log_events",
    "reduce_count": "SELECT count(*) AS result FROM log_events WHERE response_ms > 0",
    "reduce_max": "SELECT max(response_ms) AS result FROM log_events",
    "reduce_error_count": "SELECT count(*) AS result FROM log_events WHERE status = 500",
    "sort_latencies": "SELECT id, response_ms FROM log_events WHERE response_ms IS NOT NULL ORDER BY 2, 1",
    "overview": f"""
WITH s AS (SELECT max(epoch_ms(ts)) - 86400000 AS lo FROM log_events),
w AS (SELECT e.*, epoch_ms(ts) AS ms, lo, {BAD} AS bad FROM log_events e, s WHERE epoch_ms(ts) >= lo),
i AS (SELECT * FROM ({INCIDENTS.replace("FROM log_events WHERE", "FROM w WHERE")})),
t AS (SELECT count(*) AS n, count(*) FILTER (bad) AS e, count(*) FILTER (level = 'WARN') AS wa, count(DISTINCT service) AS sv, count(DISTINCT host) AS h FROM w)
SELECT 'totals' AS section, 'events' AS key, n::DOUBLE AS value FROM t UNION ALL SELECT 'totals', 'errors', e FROM t UNION ALL SELECT 'totals', 'warnings', wa FROM t
UNION ALL SELECT 'totals', 'services', sv FROM t UNION ALL SELECT 'totals', 'hosts', h FROM t UNION ALL SELECT 'totals', 'events_per_minute', n / 1440.0 FROM t
UNION ALL SELECT 'severity', l, count(id) FROM (VALUES ('TRACE'), ('DEBUG'), ('INFO'), ('WARN'), ('ERROR'), ('FATAL')) v(l) LEFT JOIN w ON level = l GROUP BY l
UNION ALL (SELECT 'service', coalesce(service, '(unknown)'), count(*) FROM w GROUP BY 2 ORDER BY 3 DESC, min(id) LIMIT 6)
UNION ALL (SELECT 'pattern', {TEMPLATE}, count(*) FROM w WHERE message IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, min(id) LIMIT 8)
UNION ALL SELECT 'status', cast(status AS VARCHAR), count(*) FROM w WHERE status <> 0 GROUP BY 2
UNION ALL SELECT 'timeline', cast(least(23, (ms - lo) // 3600000) AS VARCHAR), count(*) FROM w GROUP BY 2
UNION ALL (SELECT 'critical', cast(id AS VARCHAR), ms FROM w WHERE bad ORDER BY ts DESC, id DESC LIMIT 12)
UNION ALL SELECT 'incident', cast(start_ms AS VARCHAR) || '-' || cast(end_ms AS VARCHAR), errors FROM i
UNION ALL SELECT 'heatmap', cast(c // 24 AS VARCHAR) || '/' || cast(c % 24 AS VARCHAR), count(id) FROM range(168) r(c) LEFT JOIN w ON (isodow(timezone('UTC', ts)) - 1) * 24 + hour(timezone('UTC', ts)) = c GROUP BY 2""",
}


def _unit(*parts: str) -> str:
    """The first 40 bits of the MD5 of the parts joined with slashes, as a number in [0, 1)."""
    return f"(('0x' || substr(md5({' || chr(47) || '.join(parts)}), 1, 10))::BIGINT / 1099511627776.0)"


_U = [_unit("'20260913'", f"'{salt}'", "id") for salt in range(7)]
SQL["demo_events"] = f"""
WITH a AS (SELECT id, cast(floor({_U[1]} * 86400000) AS BIGINT) AS span, {_U[2]} AS pick, {_U[3]} AS lv, {_U[4]} AS late, {_U[5]} AS host, {_U[6]} AS rt FROM range(14000) r(id)),
h AS (SELECT *, span // 3600000 AS hour FROM a), b AS (SELECT h.*, coalesce(service, -1) AS bursting FROM h LEFT JOIN (VALUES (2, 6), (6, 1), (11, 6), (15, 1), (19, 6), (22, 3)) v(hour, service) ON v.hour = h.hour),
w AS (SELECT *, list_transform(range(0, 8), lambda i: CASE WHEN i = 0 THEN 26 ELSE 9 END + CASE WHEN i = bursting THEN 900 ELSE 0 END) AS weights FROM b),
i AS (SELECT *, (SELECT min(k) FROM range(0, 8) r(k) WHERE pick * list_sum(weights) < list_sum(weights[1:k + 1])) AS i FROM w),
e AS (SELECT *, ['gateway', 'accounts', 'catalog', 'billing', 'orders', 'stock', 'store-db', 'mail'][i + 1] AS service, i = bursting AS burst,
  CASE WHEN i = bursting THEN CASE WHEN lv < 0.95 THEN 'ERROR' ELSE 'WARN' END WHEN lv < 0.5 THEN 'INFO' WHEN lv < 0.6 THEN 'DEBUG' WHEN lv < 0.72 THEN 'WARN' ELSE 'ERROR' END AS level FROM i)
SELECT id, 1773000000000 - 86400000 + CASE WHEN burst THEN hour * 3600000 + cast(floor(late * 600000) AS BIGINT) ELSE span END AS ts_ms, service, level,
  service || '-' || (1 + cast(floor(host * 4) AS INTEGER)) AS host, cast(floor(5 + rt * CASE WHEN level = 'ERROR' THEN 4000 ELSE 400 END) AS BIGINT) AS response_ms FROM e"""

_V = [_unit("'42'", f"'{salt}'", "tick", "n") for salt in range(8)]
SQL["simulation_ticks"] = f"""
WITH t AS (SELECT tick, CASE WHEN tick < 8 THEN 0.0 WHEN tick < 36 THEN (tick - 8) / 28.0 WHEN tick < 140 THEN 1.0 WHEN tick < 200 THEN (200 - tick) / 60.0 ELSE 0.0 END::DOUBLE AS x FROM range(280) r(tick)),
c AS (SELECT *, least(120, greatest(1, cast(round(12.0::DOUBLE * (1 + 1.3::DOUBLE * x)) AS INTEGER))) AS count FROM t), e AS (SELECT *, unnest(range(0, count)) AS n FROM c),
f AS (SELECT tick, x, {_V[2]} < 0.004 + 0.11 * x AS failing, {_V[3]} < 0.3 AS warn, 40 + {_V[4]} * 160 AS base, {_V[5]} AS u5, {_V[6]} AS u6 FROM e)
SELECT cast(tick AS INTEGER) AS tick, CASE WHEN x <= 0 THEN 'healthy' WHEN x < 0.35 THEN 'onset' WHEN x < 0.85 THEN 'degrading' ELSE 'peak' END AS phase, count(*) AS events, count_if(failing AND NOT warn) AS errors,
  avg(floor(base + CASE WHEN failing THEN u5 * 1250 * (0.5 + x) ELSE 0.25 * 1250 * x * u6 END)) AS avg_ms FROM f GROUP BY tick, x"""

#: The session's events, then counters, bins, baselines (a recursion over the ticks), buckets and signature hits.
_SESSION = f"""
WITH RECURSIVE t AS (SELECT tick, CASE WHEN tick < 12 THEN 0.0 WHEN tick < 40 THEN (tick - 12) / 28.0 WHEN tick < 168 THEN 1.0 WHEN tick < 240 THEN (240 - tick) / 72.0 ELSE 0.0 END::DOUBLE AS x FROM range(320) r(tick)),
g AS (SELECT *, least(120, greatest(1, cast(round(12.0::DOUBLE * (1 + (1.65::DOUBLE - 1) * x)) AS INTEGER))) AS count FROM t), k AS (SELECT *, unnest(range(0, count)) AS n FROM g),
fleet AS (SELECT list(service ORDER BY service) AS names, list(base_share ORDER BY service) AS shares FROM service_nodes),
f AS (SELECT tick, x, n, names, shares, {_V[1]} AS u1, {_V[2]} < 0.004 + 0.34 * x AS failing, {_V[3]} < 0.3 AS warn, 40 + {_V[4]} * 160 AS base, {_V[5]} AS u5, {_V[6]} AS u6, {_V[7]} AS u7 FROM k, fleet),
e AS (SELECT tick, x, tick * 1000 + n AS id, failing, names[least(len(names), 1 + len(list_filter(range(1, len(names) + 1), lambda i: list_sum(shares[1:i]) <= u1 * list_sum(shares))))] AS service,
  failing AND NOT warn AS bad, failing AND warn AS warn, cast(floor(base + CASE WHEN failing THEN u5 * 1850 * (0.5 + x) ELSE 0.25 * 1850 * x * u6 END) AS BIGINT) AS ms,
  CASE WHEN failing THEN ['call refused upstream', 'pool drained', 'token not accepted'][1 + cast(floor(u7 * 3) AS INTEGER)] END AS signature FROM f),
c AS (SELECT tick, any_value(x) AS x, count(*) AS events, count_if(bad) AS tick_errors, count_if(warn) AS w, sum(ms) AS ms FROM e GROUP BY tick),
d AS (SELECT *, sum(events) OVER u AS generated, sum(tick_errors) OVER u AS errors, sum(w) OVER u AS warnings, sum(ms) OVER u AS sum_ms FROM c WINDOW u AS (ORDER BY tick)),
b AS (SELECT r.tick, bin, (SELECT count(*) FROM e WHERE e.tick <= r.tick AND least(59, e.ms // 200) = bin) AS n FROM (SELECT DISTINCT tick FROM e) r, range(60) q(bin)),
q AS (SELECT tick, (min(bin) + 1) * 200 AS p95 FROM (SELECT *, sum(n) OVER (PARTITION BY tick ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY tick) AS every FROM b) WHERE upto >= ceil(every * 0.95) GROUP BY tick),
y AS (SELECT d.tick, x, events / 0.25 AS eps, p95 FROM d JOIN q USING (tick)),
l AS (SELECT -1::BIGINT AS tick, 0.0::DOUBLE AS eps, 0::BIGINT AS p95, false AS seeded
  UNION ALL SELECT tick, CASE WHEN e1 <= 0 THEN greatest(1.0, e0) ELSE e1 END, CASE WHEN p1 <= 0 THEN greatest(1, p0) ELSE p1 END, seeded OR quiet FROM (
    SELECT y.tick, y.eps AS e0, y.p95 AS p0, l.seeded, y.x <= 0.02 AND y.tick >= 3 AS quiet,
      CASE WHEN NOT (y.x <= 0.02 AND y.tick >= 3) THEN l.eps WHEN l.eps = 0 THEN y.eps ELSE l.eps * 0.85 + y.eps * (1 - 0.85) END AS e1,
      CASE WHEN NOT (y.x <= 0.02 AND y.tick >= 3) THEN l.p95 WHEN l.seeded THEN cast(floor(l.p95 * 0.85::DOUBLE + y.p95 * (1 - 0.85::DOUBLE) + 0.5) AS BIGINT) ELSE y.p95 END AS p1 FROM l JOIN y ON y.tick = l.tick + 1)),
z AS (SELECT tick // 4 AS bucket, sum(tick_errors) AS e FROM c GROUP BY 1), zb AS (SELECT bucket, coalesce(avg(e) OVER (ORDER BY bucket ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) AS burst_baseline FROM z),
o AS (SELECT tick, tick // 4 AS bucket, cast(sum(tick_errors) OVER (PARTITION BY tick // 4 ORDER BY tick) AS BIGINT) AS bucket_errors FROM c),
p AS (SELECT tick, signature, row_number() OVER (ORDER BY tick, id) AS place FROM e), pe AS (SELECT tick, max(place) AS last FROM p GROUP BY tick),
h AS (SELECT pe.tick, p.signature, count(*) AS hits FROM pe JOIN p ON p.place <= last AND p.place > last - 600 WHERE p.signature IS NOT NULL GROUP BY 1, 2)"""
SQL["session_signatures"] = f"{_SESSION} SELECT 's1' AS session, cast(tick AS INTEGER) AS tick, signature, hits FROM h"
SQL["session_frames"] = f"""{_SESSION}
SELECT 's1' AS session, cast(d.tick AS INTEGER) AS tick, CASE WHEN d.x <= 0 THEN 'healthy' WHEN d.x < 0.35 THEN 'onset' WHEN d.x < 0.85 THEN 'degrading' ELSE 'peak' END AS phase, events, cast(generated AS BIGINT) AS generated,
  cast(errors AS BIGINT) AS errors, cast(warnings AS BIGINT) AS warnings, round(errors * 100.0::DOUBLE / generated, 2) AS error_pct,
  CASE WHEN tick_errors / events >= 0.1 THEN 'elevated' WHEN tick_errors / events >= 0.02 THEN 'watch' ELSE 'normal' END AS band, cast(sum_ms // generated AS BIGINT) AS avg_ms, cast(least(generated, 4000) AS BIGINT) AS retained,
  y.eps, round(l.eps, 6) AS base_eps, y.p95 AS p95_ms, l.p95 AS base_p95_ms, bucket, bucket_errors, round(burst_baseline, 6) AS burst_baseline,
  bucket_errors >= 4 AND (burst_baseline = 0 OR bucket_errors / burst_baseline >= 2.2) AS burst, CASE WHEN y.p95 >= 4 * l.p95 THEN 'CRITICAL' WHEN y.p95 >= 2 * l.p95 THEN 'MAJOR' END AS latency_signal, y.eps >= 2 * l.eps AS volume_signal,
  cast((SELECT count(*) FROM h WHERE h.tick = d.tick) AS INTEGER) AS signatures, cast(coalesce((SELECT sum(hits) FROM h WHERE h.tick = d.tick), 0) AS BIGINT) AS signature_hits
FROM d JOIN y USING (tick) JOIN l USING (tick) JOIN o USING (tick) JOIN zb USING (bucket)"""
SQL["session_health"] = f"""{_SESSION},
s AS (SELECT t.tick, v.service, v.tier, (SELECT count(*) FROM e WHERE e.tick <= t.tick AND e.service = v.service) AS events, (SELECT count(*) FROM e WHERE e.tick <= t.tick AND e.service = v.service AND bad) AS errors,
  (SELECT coalesce(sum(ms), 0) FROM e WHERE e.tick <= t.tick AND e.service = v.service) AS ms FROM t, service_nodes v),
r AS (SELECT s.*, CASE WHEN events = 0 THEN 0 ELSE errors * 100.0::DOUBLE / events END AS pct, CASE WHEN events = 0 THEN 0 ELSE cast(ms // events AS BIGINT) END AS avg_ms, l.p95 AS base, max(events) OVER (PARTITION BY s.tick) AS most FROM s JOIN l ON l.tick = s.tick)
SELECT 's1' AS session, cast(tick AS INTEGER) AS tick, service, tier, events, errors, round(pct, 6) AS error_pct, avg_ms,
  CASE WHEN pct >= 8 OR avg_ms >= 4 * base THEN 'critical' WHEN pct >= 3 OR avg_ms >= 2 * base THEN 'degraded' ELSE 'healthy' END AS state, round(events / most, 6) AS load FROM r"""
SQL["session_evidence"] = f"""{_SESSION}
SELECT 's1' AS session, cast(tick AS INTEGER) AS tick, 'multi-scan' AS algorithm, cast(count(*) AS VARCHAR) AS subject, cast(sum(hits) AS BIGINT) AS amount FROM h GROUP BY tick
UNION ALL SELECT 's1', cast(tick AS INTEGER), 'recount', arg_min(signature, (-hits, signature)), max(hits) FROM h GROUP BY tick
UNION ALL SELECT 's1', cast(tick AS INTEGER), 'window', cast(bucket AS VARCHAR), bucket_errors FROM o"""

#: The detector step by step over each service's buckets.
SQL["detector_readings"] = f"""
WITH RECURSIVE n AS (SELECT service, epoch_ms(ts) // 1000 AS bucket, CASE WHEN response_ms > 0 THEN least(59, response_ms // 200) ELSE -1 END AS bin, count(*) AS n, count(*) FILTER ({BAD}) AS bad
  FROM log_events WHERE service IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT service, bucket, cast(sum(n) AS BIGINT) AS events, cast(sum(bad) AS BIGINT) AS errors, map_from_entries(list((bin, n))) AS m, row_number() OVER (PARTITION BY service ORDER BY bucket) AS i FROM n GROUP BY 1, 2),
d AS (SELECT DISTINCT service, 0::BIGINT AS i, 0::BIGINT AS bucket, 0::BIGINT AS events, 0::BIGINT AS errors, 0.0::DOUBLE AS baseline, false AS burst, 0::BIGINT AS p95, false AS slow, false AS loud, []::BIGINT[] AS recent,
    list_transform(range(60), lambda k: 0::BIGINT) AS hist, 0.0::DOUBLE AS volume, 0::BIGINT AS level FROM b
  UNION ALL SELECT service, i, bucket, events, errors, baseline, burst, p95, level > 0 AND p95 >= 2 * level, volume > 0 AND events >= 2 * volume, list_append(recent, errors)[-12:], hist,
    CASE WHEN burst THEN volume WHEN volume = 0 THEN events ELSE 0.85::DOUBLE * volume + (1 - 0.85::DOUBLE) * events END,
    CASE WHEN burst THEN level WHEN level = 0 THEN p95 ELSE cast(round_even(0.85::DOUBLE * level + (1 - 0.85::DOUBLE) * p95, 0) AS BIGINT) END
  FROM (SELECT *, errors >= 4 AND (baseline = 0 OR errors / baseline >= 2.2) AS burst,
      CASE WHEN list_sum(hist) = 0 THEN 0 ELSE 200 * (1 + list_filter(range(60), lambda k: list_sum(hist[1:k + 1]) >= 0.95::DOUBLE * list_sum(hist))[1]) END AS p95 FROM (
    SELECT b.service, b.i, b.bucket, b.events, b.errors, coalesce(list_avg(d.recent), 0) AS baseline, d.recent, d.volume, d.level,
      list_transform(range(60), lambda k: d.hist[k + 1] + coalesce(b.m[k], 0)) AS hist FROM d JOIN b ON b.service = d.service AND b.i = d.i + 1)))
SELECT service AS key, bucket, events, errors, baseline, burst, p95 AS p95_ms, slow AS latency_signal, loud AS volume_signal FROM d WHERE i > 0"""

SQL["render_dataset"] = f"SELECT id, coalesce(sum(length(t) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, t AS line FROM (SELECT id, {TEXT} AS t FROM log_events)"

_L = [_unit("'42'", f"'{salt}'", "id") for salt in range(10)]


def _pick(u: str, of: tuple[str, ...]) -> str:
    return f"{list(of)}[1 + cast(floor({u} * {len(of)}) AS INTEGER)]"


SQL["sample_lines"] = f"""
WITH r AS (SELECT id, floor({_L[9]} / 0.04::DOUBLE) AS way FROM range(2000) r(id)),
f AS (SELECT id, way, [CASE WHEN way = 0 THEN 'not-a-time' ELSE strftime(make_timestamp((1789257600000 + id) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END,
  CASE WHEN way = 2 THEN 'ALERT' ELSE {_pick(_L[1], ("INFO", "INFO", "DEBUG", "WARN", "ERROR"))} END, {_pick(_L[2], ("gateway", "accounts", "catalog", "billing", "orders", "stock", "store-db", "mail"))},
  '192.0.2.' || cast(floor({_L[3]} * 254 + 1) AS INTEGER), {_pick(_L[4], ("GET", "POST", "PUT"))}, '/v1/items', {_pick(_L[5], ("200", "404", "500"))}, cast(cast(floor({_L[6]} * 900) AS INTEGER) AS VARCHAR), 'req-' || id,
  CASE WHEN {_L[7]} < 0.2 THEN '-' ELSE 'user-' || cast(floor({_L[8]} * 500) AS INTEGER) END, 'handled request ' || id || CASE WHEN way = 3 THEN ' | again' ELSE '' END] AS x FROM r)
SELECT id + 1 AS line_no, array_to_string(CASE WHEN way = 1 THEN x[1:4] ELSE x END, ' | ') AS line FROM f"""
