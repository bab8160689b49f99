"""Step traces of algorithms: (step, operation, description, state), at most 400 steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from cindertrail.functions import covers, dynamic, flows
from cindertrail.functions import numbers as nums
from cindertrail.functions.textalgos import border_array, edit_script, edit_table, z_array

MAX_STEPS = 400
Step = tuple[str, str, str]


def naive(text: str, pattern: str) -> Iterator[Step]:
    for i in range(len(text) - len(pattern) + 1):
        k = next((j for j, c in enumerate(pattern) if text[i + j] != c), len(pattern))
        yield ("match" if k == len(pattern) else "mismatch", f"start {i}: {k} of {len(pattern)} equal", str(i))


def kmp(text: str, pattern: str) -> Iterator[Step]:
    border = border_array(pattern)
    yield "borders", f"failure table of {pattern}", str(border)
    k = 0
    for i, c in enumerate(text):
        while k and (k == len(pattern) or pattern[k] != c):
            yield "fall back", f"at {i}: {k} to {border[k - 1]}", str(k)
            k = border[k - 1]
        k += k < len(pattern) and pattern[k] == c
        yield ("match", f"occurrence at {i - k + 1}", str(k)) if k == len(pattern) else ("advance", f"at {i}: {k} equal", str(k))


def z_search(text: str, pattern: str) -> Iterator[Step]:
    joined = f"{pattern}\0{text}"
    for i, v in enumerate(z_array(joined)):
        if i > len(pattern):
            yield ("match" if v == len(pattern) else "prefix", f"text place {i - len(pattern) - 1}: common prefix {v}", str(v))


def rabin_karp(text: str, pattern: str, base: int = 257, mod: int = 1_000_000_007) -> Iterator[Step]:
    def value(s: str) -> int:
        h = 0
        for c in s:
            h = (h * base + ord(c)) % mod
        return h

    want = value(pattern)
    yield "hash", f"pattern hash {want}", str(want)
    for i in range(len(text) - len(pattern) + 1):
        have = value(text[i : i + len(pattern)])
        if have == want:
            same = text.startswith(pattern, i)
            yield ("match" if same else "collision", f"start {i}", str(have))
        else:
            yield "roll", f"start {i}", str(have)


def levenshtein(a: str, b: str) -> Iterator[Step]:
    for i, row in enumerate(edit_table(a, b)):
        yield "row", f"costs of the first {i} characters", str(row)
    for op in edit_script(a, b):
        yield "edit", op, ""


def matrix_chain(dims: list[int]) -> Iterator[Step]:
    n = len(dims) - 1
    cost: dict[tuple[int, int], int] = {(i, i): 0 for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size - 1
            for k in range(i, j):
                c = cost[i, k] + cost[k + 1, j] + dims[i] * dims[k + 1] * dims[j + 1]
                better = (i, j) not in cost or c < cost[i, j]
                yield ("improve" if better else "keep", f"A{i + 1}..A{j + 1} split after A{k + 1}: {c}", str(cost.get((i, j), "")))
                if better:
                    cost[i, j] = c
    yield "result", dynamic.matrix_chain(dims)[1], str(cost[0, n - 1])


def augmenting(n: int, edges: list[tuple[int, int, int]], s: int, t: int, depth_first: bool) -> Iterator[Step]:
    net, total = flows.Network(n, edges), 0
    while s != t and (arcs := net._search(s, t, depth_first)):
        path = [s] + [net.to[a] for a in reversed(arcs)]
        amount = net.push(arcs)
        total += amount
        yield "augment", f"{amount} along {path}", str(total)
    yield "result", f"no path left, flow {total}", str(sorted(net.source_side(s)))


def dinic(n: int, edges: list[tuple[int, int, int]], s: int, t: int) -> Iterator[Step]:
    value, phases, net = flows.max_flow(n, edges, s, t)
    for k, e in enumerate(edges):
        yield "edge", f"{e[0]} to {e[1]}: {net.flow(k)} of {e[2]}", str(net.capacity[k] - net.flow(k))
    yield "result", f"flow {value} in {phases} phases", str(value)


def vertex_cover(edges: list[tuple[int, int]]) -> Iterator[Step]:
    chosen: set[int] = set()
    for u, v in edges:
        if u == v and u not in chosen:
            chosen.add(u)
            yield "loop", f"take {u}", str(sorted(chosen))
    for u, v in edges:
        if u in chosen or v in chosen:
            yield "covered", f"edge {u}-{v}", str(sorted(chosen))
        else:
            chosen |= {u, v}
            yield "take both", f"edge {u}-{v}", str(sorted(chosen))
    yield "result", f"cover of {len(covers.vertex_cover(edges))}", str(sorted(chosen))


def miller_rabin(n: int) -> Iterator[Step]:
    d, s = n - 1, 0
    while d and d % 2 == 0:
        d, s = d // 2, s + 1
    yield "split", f"{n} - 1 = {d} x 2^{s}", ""
    for a in nums.WITNESSES:
        if a < n:
            yield ("passes" if nums.is_prime(n, [a]) else "composite"), f"base {a}", str(pow(a, d, n))
    yield "result", "prime" if nums.is_prime(n) else "not prime", ""


def reservoir(stream: list, k: int, seed: int = 42) -> Iterator[Step]:
    before: list = []
    for i in range(len(stream)):
        now = nums.reservoir(stream[: i + 1], k, seed)
        yield ("keep" if now != before else "pass"), f"item {stream[i]}", str(now)
        before = now


def universal_hash(keys: list[int], m: int = 64, seed: int = 1337) -> Iterator[Step]:
    a, b = nums.family(seed)
    yield "draw", f"a {a}, b {b}", ""
    filled: dict[int, int] = {}
    for x in keys:
        slot = (a * x + b) % nums.MERSENNE % m
        yield ("collision" if slot in filled else "place"), f"{x} in bucket {slot}", str(filled.get(slot, ""))
        filled.setdefault(slot, x)


TRACES: dict[str, Callable[..., Iterator[Step]]] = {
    "naive": naive, "kmp": kmp, "z": z_search, "rabin-karp": rabin_karp, "levenshtein": levenshtein, "matrix-chain": matrix_chain,
    "ford-fulkerson": lambda n, e, s, t: augmenting(n, e, s, t, True), "edmonds-karp": lambda n, e, s, t: augmenting(n, e, s, t, False), "dinic": dinic,
    "vertex-cover": vertex_cover, "miller-rabin": miller_rabin, "reservoir": reservoir, "universal-hash": universal_hash,
}


def trace(name: str, *args, limit: int = MAX_STEPS) -> tuple[list[tuple[int, str, str, str]], bool]:
    """(numbered steps, truncated) of an algorithm by name."""
    steps = []
    for i, step in enumerate(TRACES[name](*args)):
        if i >= limit:
            return steps, True
        steps.append((i, *step))
    return steps, False
