"""Dynamic programmes over one small instance each."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np


def matrix_chain(dims: Sequence[int]) -> tuple[int, str]:
    """(least scalar multiplications, bracketing) of a product of len(dims) - 1 matrices; first best split wins."""
    n = len(dims) - 1
    if n < 1 or min(dims) <= 0 or n > 200:
        raise ValueError("2 to 201 positive dimensions")
    cost, cut = [[0] * n for _ in range(n)], [[0] * n for _ in range(n)]
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size - 1
            cost[i][j], cut[i][j] = min((cost[i][k] + cost[k + 1][j] + dims[i] * dims[k + 1] * dims[j + 1], k) for k in range(i, j))

    def show(i: int, j: int) -> str:
        return f"A{i + 1}" if i == j else f"({show(i, cut[i][j])} x {show(cut[i][j] + 1, j)})"

    return cost[0][n - 1], show(0, n - 1)


def optimal_search_tree(freqs: Sequence[int]) -> tuple[int, int]:
    """(least weighted depth, index of the first best root); the root has depth 1."""
    n = len(freqs)
    if not 1 <= n <= 400:
        raise ValueError("1 to 400 frequencies")
    upto = [0]
    for f in freqs:
        upto.append(upto[-1] + f)
    cost = [[0] * (n + 1) for _ in range(n + 2)]
    root = 0
    for size in range(1, n + 1):
        for i in range(n - size + 1):
            j = i + size
            best, r = min((cost[i][k] + cost[k + 1][j], k) for k in range(i, j))
            cost[i][j] = best + upto[j] - upto[i]
            if size == n:
                root = r
    return cost[0][n], root


def shortest_tour(distance: Sequence[Sequence[int]], start: int = 0) -> tuple[int, list[int]]:
    """(length, cities from start) of the shortest closed tour; -1 marks no edge; (-1, []) if there is none."""
    n = len(distance)
    if not 1 <= n <= 18:
        raise ValueError("1 to 18 cities")
    if n == 1:
        return 0, [start]
    best: dict[tuple[int, int], tuple[int, int]] = {(1 << start, start): (0, -1)}
    frontier = {(1 << start, start)}
    for _ in range(n - 1):
        nxt = set()
        for seen, at in frontier:
            base = best[seen, at][0]
            for to in range(n):
                if not seen >> to & 1 and distance[at][to] >= 0:
                    key, cost = (seen | 1 << to, to), base + distance[at][to]
                    if key not in best or (cost, at) < best[key]:
                        best[key] = (cost, at)
                    nxt.add(key)
        frontier = nxt
    full = (1 << n) - 1
    ends = [(best[full, v][0] + distance[v][start], v) for v in range(n) if (full, v) in best and distance[v][start] >= 0 and v != start]
    if not ends:
        return -1, []
    length, at = min(ends)
    path, seen = [], full
    while at != -1:
        path.append(at)
        seen, at = seen & ~(1 << at), best[seen, at][1]
    return length, path[::-1]


def hamiltonian_path(n: int, edges: Sequence[tuple[int, int]]) -> list[int] | None:
    """A path through all vertices of an undirected graph, or None."""
    if not 1 <= n <= 18:
        raise ValueError("1 to 18 vertices")
    near = [0] * n
    for u, v in edges:
        if u != v:
            near[u] |= 1 << v
            near[v] |= 1 << u
    ends = [0] * (1 << n)  # per set of vertices, those a path over the set can end in
    for v in range(n):
        ends[1 << v] = 1 << v
    for seen in range(1, 1 << n):
        for v in range(n):
            if ends[seen] >> v & 1:
                for to in range(n):
                    if not seen >> to & 1 and near[v] >> to & 1:
                        ends[seen | 1 << to] |= 1 << to
    seen = (1 << n) - 1
    if not ends[seen]:
        return None
    at = (ends[seen] & -ends[seen]).bit_length() - 1
    path = [at]
    while seen != 1 << at:
        rest = seen & ~(1 << at)
        prev = ends[rest] & near[at]
        seen, at = rest, (prev & -prev).bit_length() - 1
        path.append(at)
    return path


class Tree:
    """Undirected weighted tree of n vertices; checks that n - 1 edges connect all."""

    def __init__(self, n: int, edges: Sequence[tuple[int, int, int]]):
        self.n, self.near = n, [[] for _ in range(n)]
        for u, v, w in edges:
            self.near[u].append((v, w))
            self.near[v].append((u, w))
        self.order, self.parent, self.up = [0], [-1] * n, [0] * n
        for u in self.order:
            for v, w in self.near[u]:
                if v != self.parent[u]:
                    if v == 0 or self.parent[v] >= 0:
                        raise ValueError("not a tree")
                    self.parent[v], self.up[v] = u, w
                    self.order.append(v)
        if len(edges) != n - 1 or len(self.order) != n:
            raise ValueError("not a tree")

    def distances(self, source: int) -> list[int]:
        dist = [-1] * self.n
        dist[source], queue = 0, [source]
        for u in queue:
            for v, w in self.near[u]:
                if dist[v] < 0:
                    dist[v] = dist[u] + w
                    queue.append(v)
        return dist

    def diameter(self) -> tuple[int, int, int]:
        """(length, end, end) for non-negative weights, by two sweeps."""
        first = self.distances(0)
        a = max(range(self.n), key=lambda v: (first[v], -v))
        dist = self.distances(a)
        b = max(range(self.n), key=lambda v: (dist[v], -v))
        return dist[b], min(a, b), max(a, b)

    def sizes(self) -> list[int]:
        size = [1] * self.n
        for u in reversed(self.order[1:]):
            size[self.parent[u]] += size[u]
        return size

    def distance_sums(self) -> list[int]:
        """Per vertex the sum of distances to all others, by moving the root along each edge."""
        size, depth = self.sizes(), [0] * self.n
        for u in self.order[1:]:
            depth[u] = depth[self.parent[u]] + self.up[u]
        sums = [sum(depth)] + [0] * (self.n - 1)
        for u in self.order[1:]:
            sums[u] = sums[self.parent[u]] + (self.n - 2 * size[u]) * self.up[u]
        return sums

    def centroids(self) -> list[int]:
        """Vertices whose removal leaves no part of more than half."""
        size = self.sizes()
        worst = [self.n - s for s in size]
        for u in self.order[1:]:
            worst[self.parent[u]] = max(worst[self.parent[u]], size[u])
        return [u for u in range(self.n) if 2 * worst[u] <= self.n]

    def subset_sums(self, value: Sequence[int]) -> set[int]:
        """Sums of the values of vertex sets that hold the root and, with a vertex, its ancestors."""
        sums: list[set[int]] = [set() for _ in range(self.n)]
        for u in reversed(self.order):
            total = {value[u]}
            for v, _ in self.near[u]:
                if v != self.parent[u]:
                    total |= {x + y for x in total for y in sums[v]}
            sums[u] = total
        return sums[0]


def subset_totals(values: Sequence[int]) -> list[int]:
    """Per bit mask the sum of the values of all its submasks; the length is a power of two."""
    n = len(values)
    if n < 1 or n & (n - 1) or n > 1 << 22:
        raise ValueError("the number of values must be a power of two up to 2^22")
    out, bit = list(values), 1
    while bit < n:
        for mask in range(n):
            if mask & bit:
                out[mask] += out[mask ^ bit]
        bit *= 2
    return out


def knapsack_fptas(items: Sequence[tuple[int, int]], capacity: int, eps: float, most: int = 5000) -> tuple[int, int, list[int]]:
    """(value, weight, item indexes) of a choice of (weight, value) items: at least 1 - eps of the best value.

    Values are rounded to parts of a greedy choice, which is worth at least half the best. Beyond
    ``most`` items the greedy choice itself is taken; it is good enough once no item is worth more
    than ``eps`` of it, else an error is raised.
    """
    if not 0 < eps < 1:
        raise ValueError("0 < eps < 1")
    fits = [(i, w, v) for i, (w, v) in enumerate(items) if 0 <= w <= capacity and v > 0]
    if not fits:
        return 0, 0, []
    greedy, total, worth = [], 0, 0
    for i, w, v in sorted(fits, key=lambda x: (-x[2] / x[1] if x[1] else float("-inf"), x[1], x[2])):
        if total + w > capacity:
            break
        greedy.append(i)
        total, worth = total + w, worth + v
    top = max(v for _, _, v in fits)
    if len(fits) > most:
        if top > eps * worth:
            raise ValueError(f"more than {most} items with single ones of over {eps} of the greedy value")
        return worth, total, sorted(greedy)
    scale = eps * max(worth, top) / len(fits)
    states = int(2 * max(worth, top) / scale) + len(fits) + 2  # no choice is worth more than twice the greedy one
    weight = np.full(states, capacity + 1, dtype=np.int64)
    weight[0] = 0
    gains, taken = [], []
    for _, w, v in fits:
        gain = int(v / scale)
        with_it = weight[: states - gain] + w
        better = (with_it < weight[gain:]) & (with_it <= capacity)
        weight[gain:][better] = with_it[better]
        gains.append(gain)
        taken.append(np.packbits(better))  # by the state it came from
    at, chosen = int(np.flatnonzero(weight <= capacity)[-1]), []
    for (i, _, _), gain, bits in zip(reversed(fits), reversed(gains), reversed(taken)):
        before = at - gain
        if before >= 0 and bits[before >> 3] >> (7 - (before & 7)) & 1:
            chosen.append(i)
            at = before
    chosen.sort()
    return sum(items[i][1] for i in chosen), sum(items[i][0] for i in chosen), chosen


def min_vertex_cover(n: int, edges: Sequence[tuple[int, int]]) -> list[int]:
    """Exact, by size; for small graphs and checks."""
    for k in range(n + 1):
        for c in combinations(range(n), k):
            s = set(c)
            if all(u in s or v in s for u, v in edges):
                return list(c)
    return list(range(n))
