import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cindertrail import registry
from cindertrail.functions import covers, dynamic, flows, numbers, textalgos
from cindertrail.operators import engines as E

SHORT = st.text(alphabet="abc", max_size=14)


@given(SHORT, st.text(alphabet="abc", min_size=1, max_size=4))
@settings(deadline=None, max_examples=120)
def test_matchers_agree(text, pattern):
    want = [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]
    assert textalgos.occurrences(text, pattern) == want == textalgos.hash_matches(text, pattern)[0]
    z = textalgos.z_array(pattern + "#" + text)
    assert [i - len(pattern) - 1 for i in range(len(pattern) + 1, len(z)) if z[i] == len(pattern)] == want
    assert [s for s, _ in textalgos.Dictionary([pattern, pattern]).find(text)] == want
    k, hits = 0, []
    lps = textalgos.border_array(pattern)
    for i, c in enumerate(text):
        while k and (k == len(pattern) or c != pattern[k]):
            k = lps[k - 1]
        k += c == pattern[k]
        if k == len(pattern):
            hits.append(i - k + 1)
    assert hits == want


def test_dictionary_order_and_hash_collisions():
    d = textalgos.Dictionary(["ab", "b", "abc", "", "b"])
    assert d.find("xabc") == [(1, 0), (2, 1), (1, 2)]
    assert textalgos.hash_matches("abcabc", "abc", 1, (3,))[0] == [0, 3]


@given(st.text(alphabet="ab", max_size=20))
@settings(deadline=None, max_examples=80)
def test_suffixes(text):
    sa = textalgos.suffix_array(text)
    assert sa == sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert textalgos.lcp_array(text, sa) == [0 if i == 0 else common(text[sa[i - 1] :], text[s:]) for i, s in enumerate(sa)]


@given(SHORT, SHORT)
@settings(deadline=None, max_examples=80)
def test_edit_scripts_replay(a, b):
    out, i = [], 0
    script = textalgos.edit_script(a, b)
    for op in script:
        kind, *args = op.split(" ")
        if kind in ("MATCH", "SUBSTITUTE", "DELETE"):
            assert a[i] == args[0]
            i += 1
        if kind != "DELETE":
            out.append(args[-1])
    assert "".join(out) == b and i == len(a) and sum(not o.startswith("MATCH") for o in script) == textalgos.edit_distance(a, b)
    assert textalgos.edit_distance(a, b, swaps=True) <= textalgos.edit_distance(a, b)


def test_edit_variants():
    assert textalgos.edit_distance("ca", "abc", swaps=True) == 3 and textalgos.edit_distance("ab", "ba", swaps=True) == 1
    assert textalgos.edit_distance("kitten", "sitting") == 3 and textalgos.edit_distance("a", "b", 1, 1, 5) == 2
    with pytest.raises(ValueError):
        textalgos.edit_distance("a", "b", -1)


@given(SHORT, SHORT)
@settings(deadline=None, max_examples=60)
def test_alignments_add_up(a, b):
    g = textalgos.align(a, b, 2, -1, -2)
    cost = lambda cols: sum(2 if x == y else -2 if None in (x, y) else -1 for x, y in cols)
    assert cost(g["columns"]) == g["score"] and "".join(x for x, _ in g["columns"] if x) == a and "".join(y for _, y in g["columns"] if y) == b
    loc = textalgos.align(a, b, 2, -1, -2, local=True)
    best = max((textalgos.align(a[i:j], b[k:m], 2, -1, -2)["score"] for i in range(min(5, len(a)) + 1) for j in range(i, min(5, len(a)) + 1) for k in range(min(5, len(b)) + 1) for m in range(k, min(5, len(b)) + 1)), default=0)
    assert cost(loc["columns"]) == loc["score"] >= max(0, best)
    assert textalgos.identity_pct([("-", "-"), ("a", None)]) == 50


def test_interval_programmes():
    assert dynamic.matrix_chain([10, 20, 30, 40, 30]) == (30000, "(((A1 x A2) x A3) x A4)")
    assert dynamic.optimal_search_tree([34, 8, 50]) == (142, 2)
    with pytest.raises(ValueError):
        dynamic.matrix_chain([5])


def test_tours_and_paths():
    rng = random.Random(1)
    for n in (1, 2, 5, 6):
        d = [[0 if i == j else rng.randrange(1, 20) for j in range(n)] for i in range(n)]
        best = min(sum(d[a][b] for a, b in zip((0, *p), (*p, 0))) for p in itertools.permutations(range(1, n))) if n > 1 else 0
        length, path = dynamic.shortest_tour(d)
        assert length == best and sorted(path) == list(range(n)) and path[0] == 0
    assert dynamic.shortest_tour([[0, -1], [-1, 0]]) == (-1, [])
    for _ in range(30):
        n = rng.randrange(1, 7)
        edges = [(u, v) for u in range(n) for v in range(u) if rng.random() < 0.5]
        near = {frozenset(e) for e in edges}
        exists = any(all(frozenset(x) in near for x in zip(p, p[1:])) for p in itertools.permutations(range(n)))
        path = dynamic.hamiltonian_path(n, edges)
        assert (path is not None) == exists and (path is None or all(frozenset(x) in near for x in zip(path, path[1:])))


def test_trees():
    rng = random.Random(2)
    for n in (1, 2, 9, 15):
        edges = [(rng.randrange(v), v, rng.randrange(1, 9)) for v in range(1, n)]
        t = dynamic.Tree(n, edges)
        dist = [t.distances(u) for u in range(n)]
        assert t.diameter()[0] == max(map(max, dist)) and t.distance_sums() == [sum(d) for d in dist]
        parts = {u: max([0] + [len(c) for c in components(n, edges, u)]) for u in range(n)}
        assert t.centroids() == [u for u in range(n) if 2 * parts[u] <= n]
        values, parent = [rng.randrange(5) for _ in range(n)], t.parent
        sets = [s for k in range(1, n + 1) for s in itertools.combinations(range(n), k) if n < 10 and 0 in s and all(v == 0 or parent[v] in s for v in s)]
        if n < 10:
            assert t.subset_sums(values) == {sum(values[v] for v in s) for s in sets}
    with pytest.raises(ValueError):
        dynamic.Tree(3, [(0, 1, 1), (0, 1, 1)])


def components(n, edges, without):
    left, out = set(range(n)) - {without}, []
    while left:
        part = {left.pop()}
        grow = True
        while grow:
            grow = {v for a, b, _ in edges for u, v in ((a, b), (b, a)) if u in part and v in left}
            part |= grow
            left -= grow
        out.append(part)
    return out


def test_subsets_and_knapsack():
    assert dynamic.subset_totals([1, 2, 3, 4]) == [1, 3, 4, 10]
    rng = random.Random(3)
    for _ in range(20):
        items = [(rng.randrange(1, 20), rng.randrange(1, 50)) for _ in range(9)]
        best = max(sum(v for _, v in c) for k in range(10) for c in itertools.combinations(items, k) if sum(w for w, _ in c) <= 40)
        value, weight, chosen = dynamic.knapsack_fptas(items, 40, 0.1)
        assert value >= 0.9 * best and weight <= 40 and sum(items[i][1] for i in chosen) == value


def brute_cut(n, edges, s, t):
    return min(sum(c for u, v, c in edges if m >> u & 1 and not m >> v & 1) for m in range(1 << n) if m >> s & 1 and not m >> t & 1)


def test_flows():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(2, 7)
        edges = [(u, v, rng.randrange(0, 9)) for u in range(n) for v in range(n) if u != v and rng.random() < 0.5]
        want = brute_cut(n, edges, 0, n - 1)
        for m in ("dinic", "edmonds-karp", "ford-fulkerson"):
            value, _, net = flows.max_flow(n, edges, 0, n - 1, m)
            kept = [sum(net.flow(k) * ((v == x) - (u == x)) for k, (u, v, _) in enumerate(edges)) for x in range(1, n - 1)]
            assert value == want and not any(kept) and all(0 <= net.flow(k) <= e[2] for k, e in enumerate(edges))
        cap, side, crossing = flows.min_cut(n, edges, 0, n - 1)
        assert cap == want == sum(edges[k][2] for k in crossing) and 0 in side


def test_matching_and_costs():
    rng = random.Random(5)
    for _ in range(25):
        left, right = list("abcd")[: rng.randrange(1, 5)], list("wxyz")[: rng.randrange(1, 5)]
        edges = [(a, b) for a in left for b in right if rng.random() < 0.5]
        best = max(k for k in range(5) for c in itertools.combinations(edges, k) if len({a for a, _ in c}) == len({b for _, b in c}) == k)
        got = flows.matching(left, right, edges)
        assert len(got) == best == len({a for a, _ in got}) == len({b for _, b in got}) and set(got) <= set(edges)
    net = flows.Network(4, [(0, 1, 2), (0, 2, 1), (1, 3, 1), (2, 3, 2), (1, 2, 1)], [1, 2, 3, 1, 1])
    assert net.cheapest(0, 3) == (3, (1 + 1 + 1) + (2 + 1) + (1 + 3))
    with pytest.raises(ValueError):
        flows.Network(3, [(0, 1, 1), (1, 0, 1), (1, 2, 1)], [-2, -2, 1]).cheapest(0, 2)


def test_covers():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 8)
        edges = [(u, v) for u in range(n) for v in range(u + 1) if rng.random() < 0.35]
        least = len(dynamic.min_vertex_cover(n, edges))
        cover = covers.vertex_cover(edges)
        assert covers.is_cover(set(cover), edges)
        loops = {u for u, v in edges if u == v}
        assert len(cover) <= 2 * least + len(loops)
        for k in range(n + 1):
            found = covers.bounded_cover(edges, k)
            assert (found is not None) == (k >= least) and (found is None or covers.is_cover(set(found), edges))
            reduced = covers.kernel(edges, k)
            if reduced is None:
                assert k < least
            else:
                assert (covers.bounded_cover(reduced[1], reduced[2]) is not None) == (k >= least)
        simple = [e for e in edges if e[0] != e[1]]
        free = set(range(n)) - set(dynamic.min_vertex_cover(n, simple))
        assert covers.is_independent(free, simple) and covers.is_clique(free, n, covers.complement_edges(n, simple))
    assert covers.set_cover([1, 2, 3, 4], [[1], [1, 2], [3, 2], [9]]) == ([1, 2], [4])
    assert covers.matched_edges([(0, 1), (1, 2), (2, 3)]) == [(0, 1), (2, 3)]


def test_numbers():
    sieve = [n for n in range(2, 2000) if all(n % d for d in range(2, int(n**0.5) + 1))]
    assert [n for n in range(2000) if numbers.is_prime(n)] == sieve == [n for n in range(2000) if numbers.probably_prime(n)]
    assert numbers.is_prime(2**61 - 1) and not numbers.is_prime(3215031751)
    kept = [numbers.reservoir(range(20), 5, seed) for seed in range(4000)]
    assert all(len(set(k)) == 5 for k in kept)
    hits = [sum(i in k for k in kept) for i in range(20)]
    assert max(hits) < 1150 and min(hits) > 850 and numbers.reservoir(range(3), 5) == [0, 1, 2]
    table = numbers.PerfectHash([x * x for x in range(300)])
    assert all(x * x in table for x in range(300)) and 7 not in table
    assert numbers.text_key("ab") == 97 * 131 + 98
    with pytest.raises(ValueError):
        numbers.PerfectHash([1, 1])


def test_distributed_suffix_ranks(spark):
    text = "abracadabra|abra"
    df = spark.createDataFrame(list(enumerate(text)), "pos int, ch string")
    got = sorted((r.rank, r.pos) for r in E.distributed_suffix_ranks(df).collect())
    assert [p for _, p in got] == textalgos.suffix_array(text)


def test_grouped_engines(spark):
    e = spark.createDataFrame([("d", "a", "b", 3), ("d", "b", "c", 2), ("x", "a", "c", 7)], "day string, source string, target string, weight long")
    assert {(r.day, r.max_flow) for r in E.max_flows(e, "day", "a", "c").collect()} == {("d", 2), ("x", 7)}
    assert {(r.day, r.capacity, r.source_side) for r in E.min_cuts(e, "day", "a", "c").collect()} == {("d", 2, "a,b"), ("x", 7, "a")}
    s = spark.createDataFrame([("k", i, v) for i, v in enumerate([10, 20, 30])], "k string, pos int, value long")
    assert E.matrix_chains(s, "k").first().cost == 6000
    r = spark.createDataFrame([("k", i) for i in range(50)], "k string, id long")
    assert E.reservoirs(r, "k", "id", 7).count() == 7
    v = spark.createDataFrame([(m, m + 1) for m in range(4)], "mask long, value long")
    assert sorted((x.mask, x.value) for x in E.subset_sums_joined(v, 2).collect()) == [(0, 1), (1, 3), (2, 4), (3, 10)]
    with pytest.raises(Exception, match="at most 1 are taken"):
        E.per_instance(e, "day", lambda p: {"n": 1}, "n int", 1).collect()


def test_registry(spark):
    assert len(registry.ENGINES) == 35
    assert registry.engine("pattern_search", "kmp")("aaa", "aa") == {"positions": [0, 1], "lps": [0, 1]}
    with pytest.raises(LookupError):
        registry.engine("NONE", "KMP")
    registry.register_functions(spark)
    assert list(spark.sql("select ct_positions('aaa', 'aa'), ct_damerau('ab', 'ba'), ct_is_prime(97L)").first()) == [[0, 1], 1, True]
