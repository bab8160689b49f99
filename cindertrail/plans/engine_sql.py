"""Oracle SQL (DuckDB) of the engine queries that SQL can express."""

from __future__ import annotations

from cindertrail.functions.numbers import MERSENNE, family
from cindertrail.plans.log_sql import TEMPLATE

_PATTERNS = ["timed out", "time", "out after", "peer", "closed the channel", "channel", "after"]
_A, _B = family(1337)
_TEMPLATES = f"""
SELECT * FROM (SELECT level, a, lag(a) OVER (PARTITION BY level ORDER BY a) AS b FROM (
  SELECT DISTINCT level, {TEMPLATE} AS a FROM log_events WHERE message IS NOT NULL AND level IS NOT NULL)) WHERE b IS NOT NULL"""
_STARTS = "SELECT id, i - 1 AS start FROM log_events, range(1, 3000) r(i) WHERE i <= length(message) AND substring(message, i, 2) = 'ed'"
_SUFFIX = f"SELECT a, s AS start, substring(a, s + 1) AS suf FROM (SELECT DISTINCT a FROM ({_TEMPLATES})), range(0, 3000) r(s) WHERE s < length(a)"
_SLOT = f"(cast({_A} AS HUGEINT) * cast(id AS HUGEINT) + {_B}) % {MERSENNE} % 64"
_MASKS = """
SELECT m AS mask, coalesce(v, 0) AS value FROM range(128) r(m) LEFT JOIN (
  SELECT mask, count(*) AS v FROM (SELECT request_id, sum(DISTINCT 1 << (isodow(timezone('UTC', ts)) - 1)) AS mask FROM log_events
    WHERE request_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1) GROUP BY 1) ON mask = m"""
_TEXT = "(SELECT string_agg(service, '|' ORDER BY service) AS t FROM service_nodes)"

_DAY_EDGES = """
SELECT day, source, target, count(*) AS weight FROM (
  SELECT strftime(timezone('UTC', ts), '%Y-%m-%d') AS day, service AS target, lag(service) OVER (PARTITION BY request_id ORDER BY epoch_ms(ts), id) AS source
  FROM log_events WHERE request_id IS NOT NULL AND service IS NOT NULL)
WHERE source IS NOT NULL AND source <> target GROUP BY 1, 2, 3"""
#: The least cut over all sets of services, by the max-flow min-cut theorem the largest flow.
_CUTS = f"""
WITH e AS ({_DAY_EDGES}), v AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS i FROM service_nodes),
b AS (SELECT e.day, a.i AS u, z.i AS w, weight FROM e JOIN v a ON a.service = source JOIN v z ON z.service = target),
m AS (SELECT mask FROM range(1024) r(mask), v a, v z WHERE a.service = 'edge-proxy' AND z.service = 'ledger-db' AND (mask >> a.i) & 1 = 1 AND (mask >> z.i) & 1 = 0)
SELECT day, cast(min(cut) AS BIGINT) AS {{name}} FROM (
  SELECT day, mask, sum(CASE WHEN (mask >> u) & 1 = 1 AND (mask >> w) & 1 = 0 THEN weight ELSE 0 END) AS cut FROM b, m GROUP BY 1, 2) GROUP BY 1"""
_FLOW = _CUTS.format(name="max_flow")
_GAPS = """
SELECT n_regionkey AS region, n_name AS name, avg(c_acctbal) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2"""
_SUPPLIERS = """
SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS node, cast(round(abs(s_acctbal) * 100) AS BIGINT) AS weight FROM supplier"""


def _edits(name: str, insert: int, delete: int, substitute: int, swaps: bool) -> str:
    """Edit costs row by row; what is inserted along a row is a running minimum."""
    swap = "CASE WHEN i >= 1 AND j > 1 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN prev[j - 1] + 1 ELSE 1000000000 END" if swaps else "1000000000"
    return f"""
WITH RECURSIVE p AS (SELECT level, a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM ({_TEMPLATES})),
r AS (SELECT level, a, b, x, y, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: j * {insert}) AS cur, []::BIGINT[] AS prev FROM p
  UNION ALL SELECT level, a, b, x, y, i, list_transform(range(0, len(y) + 1), lambda j: {insert} * j + list_min(list_transform(range(0, j + 1), lambda k: cand[k + 1] - {insert} * k))), old
  FROM (SELECT level, a, b, x, y, i + 1 AS i, cur AS old, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN cur[1] + {delete}
    ELSE least(cur[j + 1] + {delete}, cur[j] + CASE WHEN x[i + 1] = y[j] THEN 0 ELSE {substitute} END, {swap}) END) AS cand FROM r WHERE i < len(x)))
SELECT level, a, b, cast(cur[len(y) + 1] AS INTEGER) AS {name} FROM r WHERE i = len(x)"""


def _alignments(local: bool) -> str:
    """Alignment scores row by row, then the way back: diagonal first, then a gap in b, then one in a."""
    edge, floor = ("0", "greatest(0, {})") if local else ("-(i + 1)", "{}")
    step = floor.format("CASE WHEN j = 0 THEN " + edge + " ELSE greatest(cur[j + 1] - 1, cur[j] + CASE WHEN x[i + 1] = y[j] THEN 1 ELSE -1 END) END")
    first = "list_transform(range(0, len(y) + 1), lambda j: {})".format("0::BIGINT" if local else "-j")
    end = "arg_min(c, (-s, i, j))" if local else "max(c) FILTER (i = len(x) AND j = len(y))"
    stop = "AND c.cur[w.j + 1] <> 0" if local else ""
    return f"""
WITH RECURSIVE p AS (SELECT level, a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({_TEMPLATES})),
r AS (SELECT level, a, b, x, y, 0 AS i, {first} AS cur FROM p
  UNION ALL SELECT level, a, b, x, y, i, list_transform(range(0, len(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: cand[k + 1] + k)) - j)
  FROM (SELECT level, a, b, x, y, i + 1 AS i, list_transform(range(0, len(y) + 1), lambda j: {step}) AS cand FROM r WHERE i < len(x))),
cell AS (SELECT level, a, b, x, y, i, j, cur[j + 1] AS s, (cur[j + 1], i, j) AS c FROM (SELECT *, unnest(range(0, len(y) + 1)) AS j FROM r)),
ends AS (SELECT level, a, b, {end} AS c FROM cell GROUP BY ALL),
w AS (SELECT level, a, b, c[2] AS i, c[3] AS j, 0 AS n, 0 AS same, 0 AS gaps FROM ends
  UNION ALL SELECT level, a, b, i - (move <> 3)::INT, j - (move <> 2)::INT, n + 1, same + (move = 1 AND x[i] = y[j])::INT, gaps + (move <> 1)::INT FROM (
    SELECT w.*, c.x, c.y, CASE WHEN w.i > 0 AND w.j > 0 AND c.cur[w.j + 1] = u.cur[w.j] + CASE WHEN c.x[w.i] = c.y[w.j] THEN 1 ELSE -1 END THEN 1
      WHEN w.i > 0 AND c.cur[w.j + 1] = u.cur[w.j + 1] - 1 THEN 2 ELSE 3 END AS move
    FROM w JOIN r c ON c.level = w.level AND c.a = w.a AND c.b = w.b AND c.i = w.i LEFT JOIN r u ON u.level = w.level AND u.a = w.a AND u.b = w.b AND u.i = w.i - 1
    WHERE (w.i > 0 OR w.j > 0) {stop}))
SELECT level, a, b, cast(any_value(e.c[1]) AS INTEGER) AS score, cast(CASE WHEN max(n) = 0 THEN 100 ELSE round_even(100.0 * max(same) / max(n), 0) END AS INTEGER) AS identity_pct, cast(max(n) AS INTEGER) AS length,
  cast(max(gaps) AS INTEGER) AS gaps, cast(min(i) AS INTEGER) AS a_from, cast(max(i) AS INTEGER) AS a_to, cast(min(j) AS INTEGER) AS b_from, cast(max(j) AS INTEGER) AS b_to
FROM w JOIN ends e USING (level, a, b) GROUP BY level, a, b"""


_HOURLY = """
SELECT service, list(value ORDER BY pos) AS v FROM (SELECT service, hour(timezone('UTC', ts)) AS pos, count(*) AS value FROM log_events WHERE service IS NOT NULL GROUP BY 1, 2) GROUP BY service"""
_CHAINS = f"""
WITH RECURSIVE h AS ({_HOURLY}),
m AS (SELECT service, v, len(v) - 1 AS n, 1 AS size, list_transform(range(0, (len(v) - 1) * (len(v) - 1)), lambda c: 0::BIGINT) AS cost,
    list_transform(range(0, (len(v) - 1) * (len(v) - 1)), lambda c: 'A' || (c // (len(v) - 1) + 1)) AS shown FROM h
  UNION ALL SELECT service, v, n, size, list_transform(range(0, n * n), lambda c: CASE WHEN c % n - c // n = size - 1 THEN pick[c + 1].cost ELSE cost[c + 1] END),
    list_transform(range(0, n * n), lambda c: CASE WHEN c % n - c // n = size - 1 THEN '(' || shown[c // n * n + pick[c + 1].k + 1] || ' x ' || shown[(pick[c + 1].k + 1) * n + c % n + 1] || ')' ELSE shown[c + 1] END)
  FROM (SELECT service, v, n, size + 1 AS size, cost, shown, list_transform(range(0, n * n), lambda c: CASE WHEN c % n - c // n = size THEN list_min(list_transform(range(c // n, c % n),
    lambda k: struct_pack(cost := cost[c // n * n + k + 1] + cost[(k + 1) * n + c % n + 1] + v[c // n + 1] * v[k + 2] * v[c % n + 2], k := k))) END) AS pick FROM m WHERE size < n))
SELECT service, cost[n] AS cost, shown[n] AS bracketing FROM m WHERE size = n"""
#: Ranges [i, j) of the frequencies as cell i * (n + 1) + j.
_SEARCH_TREES = f"""
WITH RECURSIVE h AS ({_HOURLY}),
m AS (SELECT service, v, len(v) AS n, 0 AS size, list_transform(range(0, (len(v) + 1) * (len(v) + 1)), lambda c: 0::BIGINT) AS cost, 0::BIGINT AS root FROM h
  UNION ALL SELECT service, v, n, size, list_transform(range(0, (n + 1) * (n + 1)), lambda c: CASE WHEN c % (n + 1) - c // (n + 1) = size
      THEN pick[c + 1].cost + list_sum(v[c // (n + 1) + 1 : c % (n + 1)])::BIGINT ELSE cost[c + 1] END), pick[n + 1].k
  FROM (SELECT service, v, n, size + 1 AS size, cost, list_transform(range(0, (n + 1) * (n + 1)), lambda c: CASE WHEN c % (n + 1) - c // (n + 1) = size + 1 THEN list_min(list_transform(
    range(c // (n + 1), c % (n + 1)), lambda k: struct_pack(cost := cost[c // (n + 1) * (n + 1) + k + 1] + cost[(k + 1) * (n + 1) + c % (n + 1) + 1], k := k))) END) AS pick FROM m WHERE size < n))
SELECT service, cost[n + 1] AS cost, cast(root AS INTEGER) AS root FROM m WHERE size = n"""

_UNDIRECTED = f"SELECT DISTINCT day, least(source, target) AS u, greatest(source, target) AS v FROM ({_DAY_EDGES})"
_PATHS = f"""
WITH RECURSIVE e AS ({_UNDIRECTED}), x AS (SELECT day, u AS name FROM e UNION SELECT day, v FROM e), v AS (SELECT day, name, row_number() OVER (PARTITION BY day ORDER BY name) - 1 AS i FROM x),
n AS (SELECT day, (1 << count(*)) - 1 AS every FROM v GROUP BY day),
near AS (SELECT e.day, a.i AS p, z.i AS q FROM e JOIN v a ON a.day = e.day AND a.name = e.u JOIN v z ON z.day = e.day AND z.name = e.v),
adj AS (SELECT day, p, q FROM near UNION SELECT day, q, p FROM near),
s AS (SELECT day, 1 << i AS seen, i AS pos FROM v UNION SELECT s.day, s.seen | (1 << q), q FROM s JOIN adj ON adj.day = s.day AND p = pos WHERE (s.seen >> q) & 1 = 0),
before AS (SELECT s.day, s.seen | (1 << q) AS seen, q AS pos, min(s.pos) AS prev FROM s JOIN adj ON adj.day = s.day AND p = s.pos WHERE (s.seen >> q) & 1 = 0 GROUP BY 1, 2, 3),
way AS (SELECT s.day, s.seen, min(s.pos) AS pos, 0 AS step FROM s JOIN n ON n.day = s.day AND s.seen = every GROUP BY 1, 2
  UNION ALL SELECT w.day, w.seen - (1 << w.pos), b.prev, w.step + 1 FROM way w JOIN before b ON b.day = w.day AND b.seen = w.seen AND b.pos = w.pos)
SELECT n.day, max(step) IS NOT NULL AS found, coalesce(string_agg(name, ',' ORDER BY step), '') AS path FROM n LEFT JOIN way ON way.day = n.day LEFT JOIN v ON v.day = n.day AND v.i = way.pos GROUP BY n.day"""

_HOST_ENDPOINTS = "SELECT DISTINCT service, host, endpoint FROM log_events WHERE service IS NOT NULL AND host IS NOT NULL AND endpoint IS NOT NULL"
_SET_COVERS = f"""
WITH RECURSIVE i AS (SELECT service, host, list(endpoint) AS items FROM ({_HOST_ENDPOINTS}) GROUP BY 1, 2),
g AS (SELECT service, list(struct_pack(host := host, items := items) ORDER BY host) AS sets, list_distinct(flatten(list(items))) AS rest FROM i GROUP BY service),
w AS (SELECT service, sets, rest, []::VARCHAR[] AS chosen FROM g
  UNION ALL SELECT service, sets, list_filter(rest, lambda x: NOT list_contains(sets[best].items, x)), list_append(chosen, sets[best].host)
  FROM (SELECT *, list_position(gains, list_max(gains)) AS best FROM (
    SELECT *, list_transform(sets, lambda s: len(list_filter(s.items, lambda x: list_contains(rest, x)))) AS gains FROM w WHERE len(rest) > 0) WHERE list_max(gains) > 0))
SELECT service, array_to_string(arg_max(chosen, len(chosen)), ',') AS chosen, cast(max(len(chosen)) AS INTEGER) AS sets, cast(min(len(rest)) AS INTEGER) AS uncovered FROM w GROUP BY service"""
#: By Hall's theorem: the largest matching leaves out what some set of hosts has too few endpoints for.
_MATCHINGS = f"""
WITH h AS ({_HOST_ENDPOINTS}), v AS (SELECT service, host, row_number() OVER (PARTITION BY service ORDER BY host) - 1 AS i FROM (SELECT DISTINCT service, host FROM h)),
n AS (SELECT service, count(*) AS hosts FROM v GROUP BY service), m AS (SELECT service, hosts, mask FROM n, range(4096) r(mask) WHERE mask < (1 << hosts)),
d AS (SELECT m.service, mask, bit_count(mask) - count(DISTINCT endpoint) AS lack FROM m LEFT JOIN v ON v.service = m.service AND (mask >> v.i) & 1 = 1 LEFT JOIN h ON h.service = v.service AND h.host = v.host GROUP BY 1, 2),
k AS (SELECT n.service, hosts - max(lack) AS matched, hosts FROM d JOIN n USING (service) GROUP BY n.service, hosts)
SELECT k.service, cast(matched AS INTEGER) AS matched, cast(hosts - matched AS INTEGER) AS unmatched_left, cast(e.n - matched AS INTEGER) AS unmatched_right
FROM k JOIN (SELECT service, count(DISTINCT endpoint) AS n FROM h GROUP BY service) e ON e.service = k.service"""
_VERTEX_COVERS = f"""
WITH RECURSIVE e AS ({_UNDIRECTED}), d AS (SELECT DISTINCT day, source AS u, target AS v FROM ({_DAY_EDGES})),
g AS (SELECT day, list(struct_pack(u := u, v := v) ORDER BY u, v) AS directed FROM d GROUP BY day),
a AS (SELECT day, directed, 1 AS i, []::VARCHAR[] AS used FROM g UNION ALL SELECT day, directed, i + 1, CASE WHEN list_contains(used, directed[i].u) OR list_contains(used, directed[i].v) THEN used
  ELSE list_concat(used, [directed[i].u, directed[i].v]) END FROM a WHERE i <= len(directed)),
c AS (SELECT day, list_sort(used) AS cover FROM a WHERE i = len(directed) + 1),
k AS (SELECT day, list(struct_pack(u := u, v := v)) AS rest, any_value(len(cover)) AS k, 0 AS forced FROM e JOIN c USING (day) GROUP BY day
  UNION ALL SELECT day, list_filter(rest, lambda x: x.u <> pick AND x.v <> pick), k - 1, forced + 1 FROM (
    SELECT *, list_filter(list_sort(list_distinct(flatten(list_transform(rest, lambda x: [x.u, x.v])))), lambda z: len(list_filter(rest, lambda x: x.u = z OR x.v = z)) > k)[1] AS pick FROM k) WHERE pick IS NOT NULL),
f AS (SELECT day, CASE WHEN min(k) < 0 OR arg_max(len(rest), forced) > min(k) * min(k) THEN -1 ELSE max(forced) END AS kernel_forced FROM k GROUP BY day),
x AS (SELECT day, u AS name FROM e UNION SELECT day, v FROM e), v AS (SELECT day, name, row_number() OVER (PARTITION BY day ORDER BY name) - 1 AS i FROM x),
b AS (SELECT e.day, p.i AS p, q.i AS q FROM e JOIN v p ON p.day = e.day AND p.name = e.u JOIN v q ON q.day = e.day AND q.name = e.v),
t AS (SELECT b.day, mask, count_if((mask >> p) & 1 = 0 AND (mask >> q) & 1 = 0) AS open FROM b, range(1024) r(mask) GROUP BY 1, 2)
SELECT c.day, array_to_string(cover, ',') AS cover, cast(len(cover) AS INTEGER) AS size, cast(len(cover) / 2 AS INTEGER) AS matched, cast(kernel_forced AS INTEGER) AS kernel_forced,
  (SELECT cast(min(bit_count(mask)) AS INTEGER) FROM t WHERE t.day = c.day AND open = 0) AS smallest FROM c JOIN f USING (day)"""
#: Of all least cuts the one with the smallest source side.
_CUT_SIDES = f"""
WITH e AS ({_DAY_EDGES}), v AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS i FROM service_nodes),
b AS (SELECT e.day, a.i AS u, z.i AS w, weight, source, target FROM e JOIN v a ON a.service = source JOIN v z ON z.service = target),
m AS (SELECT mask FROM range(1024) r(mask), v a, v z WHERE a.service = 'edge-proxy' AND z.service = 'ledger-db' AND (mask >> a.i) & 1 = 1 AND (mask >> z.i) & 1 = 0),
c AS (SELECT day, mask, sum(CASE WHEN (mask >> u) & 1 = 1 AND (mask >> w) & 1 = 0 THEN weight ELSE 0 END) AS cut FROM b, m GROUP BY 1, 2),
s AS (SELECT day, arg_min(mask, (cut, bit_count(mask))) AS mask, cast(min(cut) AS BIGINT) AS capacity FROM c GROUP BY day)
SELECT day, capacity, (SELECT string_agg(service, ',' ORDER BY service) FROM v WHERE (mask >> i) & 1 = 1) AS source_side,
  (SELECT coalesce(string_agg(source || '>' || target, ',' ORDER BY source, target), '') FROM b WHERE b.day = s.day AND (mask >> u) & 1 = 1 AND (mask >> w) & 1 = 0) AS crossing FROM s"""


def _cheapest_flows(services: int = 10) -> str:
    """Cheapest augmenting paths, one a step; among equal costs the fewest arcs (a hundredth part), so that no path turns in a circle.

    Arcs 2k and 2k + 1 are edge k and its way back. Distances take as many rounds as a path has arcs.
    """
    rounds = "SELECT *, list_transform(range(0, n), lambda v: CASE WHEN v = s THEN 0::BIGINT END) AS d FROM r"
    for _ in range(services - 1):
        rounds = f"SELECT * REPLACE (list_transform(range(0, n), lambda v: list_min(list_prepend(d[v + 1], list_transform(list_filter(range(0, len(room)), lambda a: head[a + 1] = v AND room[a + 1] > 0), lambda a: d[tail[a + 1] + 1] + price[a + 1])))) AS d) FROM ({rounds})"
    trace, names = f"SELECT *, t AS x0 FROM ({rounds}) WHERE d[t + 1] IS NOT NULL", []
    for i in range(1, services):
        tight = f"list_filter(range(0, len(room)), lambda a: head[a + 1] = x{i - 1} AND room[a + 1] > 0 AND d[tail[a + 1] + 1] + price[a + 1] = d[x{i - 1} + 1])[1]"
        trace = f"SELECT *, tail[a{i} + 1] AS x{i} FROM (SELECT *, CASE WHEN x{i - 1} <> s THEN {tight} END AS a{i} FROM ({trace}))"
        names.append(f"a{i}")
    return f"""
WITH RECURSIVE e AS ({_DAY_EDGES}), sp AS (SELECT service, cast(floor(avg(response_ms)) AS BIGINT) AS cost FROM log_events WHERE response_ms BETWEEN 1 AND 100000 AND service IS NOT NULL GROUP BY 1),
v AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS i FROM service_nodes),
g AS (SELECT day, a.i AS u, z.i AS w, weight, cost, row_number() OVER (PARTITION BY day ORDER BY source, target) AS k FROM e JOIN sp ON sp.service = target JOIN v a ON a.service = source JOIN v z ON z.service = target),
r AS (SELECT day, (SELECT count(*) FROM v) AS n, (SELECT i FROM v WHERE service = 'edge-proxy') AS s, (SELECT i FROM v WHERE service = 'ledger-db') AS t, flatten(list([u, w] ORDER BY k)) AS tail, flatten(list([w, u] ORDER BY k)) AS head,
    flatten(list([cost * 100 + 1, 1 - cost * 100] ORDER BY k)) AS price, flatten(list([weight, 0::BIGINT] ORDER BY k)) AS room, 0::BIGINT AS flow, 0::BIGINT AS paid FROM g GROUP BY day
  UNION ALL SELECT day, n, s, t, tail, head, price, list_transform(range(0, len(room)), lambda a: room[a + 1] - CASE WHEN list_contains(way, a) THEN b ELSE 0 END + CASE WHEN list_contains(way, xor(a, 1)) THEN b ELSE 0 END), flow + b, paid + b * cost
  FROM (SELECT *, list_min(list_transform(way, lambda a: room[a + 1])) AS b, cast(list_sum(list_transform(way, lambda a: price[a + 1] - 1)) // 100 AS BIGINT) AS cost FROM (
    SELECT *, list_filter([{", ".join(names)}], lambda a: a IS NOT NULL) AS way FROM ({trace}))))
SELECT day, max(flow) AS max_flow, arg_max(paid, flow) AS cost FROM r GROUP BY day"""


_TREE_PATHS = f"""
WITH RECURSIVE s AS ({_SUPPLIERS}), e AS (
  SELECT nation, node AS a, (node - 1) // 2 AS b, weight FROM s WHERE node > 0 UNION ALL SELECT nation, (node - 1) // 2, node, weight FROM s WHERE node > 0),
w AS (SELECT nation, node AS a, node AS b, -1::BIGINT AS came, -1::BIGINT AS first, 0::BIGINT AS d FROM s
      UNION ALL SELECT w.nation, w.a, e.b, w.b, CASE WHEN w.first < 0 THEN e.b ELSE w.first END, w.d + e.weight FROM w JOIN e ON e.nation = w.nation AND e.a = w.b AND e.b <> w.came)"""

SQL: dict[str, str] = {
    "pattern_positions": _STARTS,
    "rabin_karp_positions": _STARTS,
    "multi_pattern_scan": "SELECT id, p AS pattern, i - 1 AS start FROM log_events, (VALUES {}) v(p), range(1, 3000) r(i) WHERE i <= length(message) AND substring(message, i, length(p)) = p".format(
        ", ".join(f"('{p}')" for p in _PATTERNS)
    ),
    "suffix_search": f"SELECT a, start FROM ({_SUFFIX}) WHERE substring(suf, 1, 4) = 'hand'",
    "suffix_ranks": f"SELECT i - 1 AS pos, row_number() OVER (ORDER BY substring(t, i)) AS rank FROM {_TEXT}, range(1, 1000) r(i) WHERE i <= length(t)",
    "edit_distance": f"SELECT level, a, b, levenshtein(a, b) AS distance FROM ({_TEMPLATES})",
    "sum_over_subsets": f"WITH v AS ({_MASKS}) SELECT a.mask, cast(sum(b.value) AS BIGINT) AS value FROM v a JOIN v b ON b.mask & a.mask = b.mask GROUP BY 1",
    "primes": "SELECT s_suppkey AS n FROM supplier WHERE s_suppkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 2000) r(k) WHERE k * k <= s_suppkey AND s_suppkey % k = 0)",
    "universal_hash": f"SELECT id, cast({_SLOT} AS BIGINT) AS bucket FROM log_events",
    "hash_statistics": f"""
SELECT cast(sum(n) AS BIGINT) AS keys, cast(sum(n - 1) AS BIGINT) AS collisions, max(n) AS largest, sum(n) / 64.0 AS load
FROM (SELECT count(DISTINCT id) AS n FROM log_events GROUP BY {_SLOT})""",
    "perfect_hash_membership": "SELECT id, status FROM log_events WHERE status IN (500, 502, 503, 504, 599)",
    "border_arrays": f"""
SELECT level, a, string_agg(cast(l AS VARCHAR), ',' ORDER BY i) AS lps, string_agg(cast(z AS VARCHAR), ',' ORDER BY i) AS z FROM (
  SELECT level, a, i, (SELECT coalesce(max(k), 0) FROM range(1, 400) r(k) WHERE k < i AND substring(a, 1, k) = substring(a, i - k + 1, k)) AS l,
         CASE WHEN i = 1 THEN 0 ELSE (SELECT coalesce(max(k), 0) FROM range(1, 400) r(k) WHERE k <= length(a) - i + 1 AND substring(a, 1, k) = substring(a, i, k)) END AS z
  FROM ({_TEMPLATES}), range(1, 400) q(i) WHERE i <= length(a)) GROUP BY 1, 2""",
    "rolling_hash": """
SELECT service, cast(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(service, ''), lambda c: ord(c)::HUGEINT)),
  lambda h, c: (h * 911382323 + c) % 1000000007) AS BIGINT) AS hash FROM (SELECT DISTINCT service FROM log_events WHERE service IS NOT NULL)""",
    "suffix_arrays": f"""
SELECT a, start, CASE WHEN p IS NULL THEN 0 ELSE (SELECT coalesce(max(k), 0) FROM range(1, 400) r(k) WHERE k <= length(suf) AND substring(suf, 1, k) = substring(p, 1, k) AND k <= length(p)) END AS lcp
FROM (SELECT a, start, suf, lag(suf) OVER (PARTITION BY a ORDER BY suf) AS p FROM ({_SUFFIX}))""",
    "edit_scripts": f"SELECT level, a, b, levenshtein(a, b) AS edits FROM ({_TEMPLATES})",
    "max_flow_dinic": _FLOW,
    "max_flow_edmonds_karp": _FLOW,
    "max_flow_ford_fulkerson": _FLOW,
    "min_cut": _CUT_SIDES,
    "flow_balance": f"""
WITH f AS ({_FLOW}), x AS (SELECT day, source AS service FROM ({_DAY_EDGES}) UNION SELECT day, target FROM ({_DAY_EDGES}))
SELECT x.day, x.service, CASE service WHEN 'edge-proxy' THEN max_flow WHEN 'ledger-db' THEN -max_flow ELSE 0 END AS net, 0::BIGINT AS over_capacity FROM x JOIN f USING (day)""",
    "damerau_distance": _edits("distance", 1, 1, 1, True),
    "weighted_edit": _edits("cost", 1, 2, 3, False),
    "global_alignment": _alignments(False),
    "local_alignment": _alignments(True),
    "matrix_chain": _CHAINS,
    "optimal_bst": _SEARCH_TREES,
    "hamiltonian_path": _PATHS,
    "set_cover": _SET_COVERS,
    "bipartite_matching": _MATCHINGS,
    "vertex_cover": _VERTEX_COVERS,
    "tsp": f"""
WITH g AS ({_GAPS}), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY name) AS i FROM g),
d AS (SELECT a.region, a.i AS x, b.i AS y, cast(round(abs(a.b - b.b) * 100) AS BIGINT) AS w FROM k a JOIN k b ON a.region = b.region AND a.i <> b.i)
SELECT region, length, string_agg(name, ',' ORDER BY place) AS path FROM (SELECT b.region, b.length, unnest(b.way) AS i, generate_subscripts(b.way, 1) AS place FROM (
SELECT p.region, min(p.w + q.w + r.w + s.w + t.w) AS length, arg_min([p.x, q.x, r.x, s.x, t.x], (p.w + q.w + r.w + s.w + t.w, t.x, s.x, r.x, q.x)) AS way FROM d p JOIN d q ON q.region = p.region AND q.x = p.y JOIN d r ON r.region = p.region AND r.x = q.y
JOIN d s ON s.region = p.region AND s.x = r.y JOIN d t ON t.region = p.region AND t.x = s.y AND t.y = p.x
WHERE p.x = 1 AND len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5 GROUP BY 1) b) JOIN k USING (region, i) GROUP BY 1, 2""",
    "tree_metrics": f"""{_TREE_PATHS},
part AS (SELECT nation, a, first, count(*) AS n FROM w WHERE first >= 0 GROUP BY 1, 2, 3),
worst AS (SELECT s.nation, s.node, coalesce(max(n), 0) AS n FROM s LEFT JOIN part ON part.nation = s.nation AND part.a = s.node GROUP BY 1, 2)
SELECT nation, cast(count(DISTINCT a) AS INTEGER) AS vertices, max(d) AS diameter, (SELECT min(t) FROM (SELECT sum(d) AS t FROM w z WHERE z.nation = w.nation GROUP BY a)) AS least_sum,
  (SELECT cast(min(a) AS INTEGER) FROM w z WHERE z.nation = w.nation AND z.d = max(w.d)) AS end_a, (SELECT cast(max(b) AS INTEGER) FROM w z WHERE z.nation = w.nation AND z.d = max(w.d)) AS end_b,
  (SELECT string_agg(node, ',' ORDER BY node) FROM worst WHERE worst.nation = w.nation AND 2 * n <= (SELECT count(*) FROM s WHERE s.nation = w.nation)) AS centroids
FROM w GROUP BY nation""",
    "tree_distance_sums": f"{_TREE_PATHS} SELECT nation, cast(a AS INTEGER) AS node, cast(sum(d) AS BIGINT) AS distance_sum FROM w GROUP BY 1, 2",
    "reservoir": """
SELECT service, id, slot FROM (SELECT service, id, row_number() OVER (PARTITION BY service ORDER BY md5('42/' || service || '/' || id), id) AS slot FROM log_events WHERE service IS NOT NULL) WHERE slot <= 10""",
    "complement_graph": f"""
WITH e AS ({_UNDIRECTED}), x AS (SELECT day, u AS name FROM e UNION SELECT day, v FROM e)
SELECT a.day, a.name AS source, b.name AS target FROM x a JOIN x b ON b.day = a.day AND a.name < b.name WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.day = a.day AND u = a.name AND v = b.name)""",
    "cover_reductions": f"""
WITH c AS ({_VERTEX_COVERS}), e AS ({_UNDIRECTED}), x AS (SELECT day, u AS name FROM e UNION SELECT day, v FROM e)
SELECT day, cast(count(*) AS INTEGER) AS vertices, any_value(size) AS cover, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT list_contains(string_split(cover, ','), name)), '') AS independent, true AS clique_holds
FROM c JOIN x USING (day) GROUP BY day""",
    "modular_powers": """
WITH RECURSIVE p AS (SELECT s_suppkey, 0 AS i, s_suppkey::HUGEINT % 1000000007 AS x FROM supplier UNION ALL SELECT s_suppkey, i + 1, x * x % 1000000007 FROM p WHERE i < 16)
SELECT s_suppkey, cast(x * s_suppkey % 1000000007 AS BIGINT) AS power FROM p WHERE i = 16""",
    "tree_subset_sums": f"""
WITH RECURSIVE s AS ({_SUPPLIERS}), t AS (SELECT nation, list(1 + weight % 7 ORDER BY node) AS v FROM s GROUP BY nation),
w AS (SELECT nation, v, len(v) - 1 AS node, list_transform(v, lambda x: []::BIGINT[]) AS sums FROM t
  UNION ALL SELECT nation, v, node - 1, list_transform(range(0, len(v)), lambda i: CASE WHEN i = node THEN list_distinct(list_transform(
    flatten(list_transform(list_prepend(0::BIGINT, coalesce(sums[2 * node + 2], []::BIGINT[])), lambda a: list_transform(list_prepend(0::BIGINT, coalesce(sums[2 * node + 3], []::BIGINT[])), lambda b: a + b))),
    lambda x: x + v[node + 1])) ELSE sums[i + 1] END) FROM w WHERE node >= 0)
SELECT nation, cast(len(sums[1]) AS INTEGER) AS sums, list_max(sums[1]) AS largest FROM w WHERE node = -1""",
    "knapsack": """
WITH RECURSIVE p AS (SELECT p_brand AS brand, cast(p_size AS BIGINT) AS w, cast(round(p_retailprice * 100) AS BIGINT) AS v FROM part),
c AS (SELECT brand, cast(floor(0.25 * sum(w)) AS BIGINT) AS capacity FROM p GROUP BY brand), f AS (SELECT brand, w, v, capacity FROM p JOIN c USING (brand) WHERE w BETWEEN 0 AND capacity AND v > 0),
g AS (SELECT *, sum(w) OVER (PARTITION BY brand ORDER BY -v::DOUBLE / w, w, v ROWS UNBOUNDED PRECEDING) AS upto FROM f),
k AS (SELECT brand, count(*) AS n, greatest(coalesce(sum(v) FILTER (upto <= capacity), 0), max(v)) AS worth, any_value(capacity) AS capacity FROM g GROUP BY brand),
q AS (SELECT brand, n, capacity, 0.2::DOUBLE * worth / n AS scale, cast(floor(2 * worth / (0.2::DOUBLE * worth / n)) AS BIGINT) + n + 2 AS states FROM k),
i AS (SELECT brand, w, v, cast(floor(v / scale) AS BIGINT) AS gain, row_number() OVER (PARTITION BY brand ORDER BY w, v) AS i FROM f JOIN q USING (brand)),
d AS (SELECT brand, 0::BIGINT AS i, list_transform(range(0, states), lambda t: struct_pack(w := CASE WHEN t = 0 THEN 0::BIGINT END, v := 0::BIGINT, c := 0::BIGINT)) AS s FROM q
  UNION ALL SELECT d.brand, i.i, list_transform(range(0, len(s)), lambda t: CASE WHEN t >= gain AND s[t - gain + 1].w + i.w <= capacity AND (s[t + 1].w IS NULL OR s[t - gain + 1].w + i.w < s[t + 1].w)
    THEN struct_pack(w := s[t - gain + 1].w + i.w, v := s[t - gain + 1].v + i.v, c := s[t - gain + 1].c + 1) ELSE s[t + 1] END) FROM d JOIN i ON i.brand = d.brand AND i.i = d.i + 1 JOIN q ON q.brand = d.brand),
z AS (SELECT d.brand, list_filter(s, lambda x: x.w IS NOT NULL)[-1] AS x FROM d JOIN q USING (brand) WHERE d.i = n)
SELECT brand, x.v AS value, x.w AS weight, cast(x.c AS INTEGER) AS items FROM z""",
    "split_mix": """
WITH a AS (SELECT s_suppkey, (s_suppkey::UHUGEINT + 11400714819323198485) % 18446744073709551616 AS z FROM supplier),
b AS (SELECT s_suppkey, (xor(z::UBIGINT, z::UBIGINT >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616 AS z FROM a),
c AS (SELECT s_suppkey, (xor(z::UBIGINT, z::UBIGINT >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616 AS z FROM b), d AS (SELECT s_suppkey, xor(z::UBIGINT, z::UBIGINT >> 31)::HUGEINT AS z FROM c)
SELECT s_suppkey, cast(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS value FROM d""",
    "min_cost_flow": _cheapest_flows(),
}
