"""Flows and matchings over one small network each."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence


class Network:
    """Directed network with residual arcs; arc 2k is edge k, arc 2k + 1 its reverse."""

    def __init__(self, n: int, edges: Sequence[tuple[int, int, int]] = (), costs: Sequence[int] | None = None):
        self.n, self.out = n, [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.capacity: list[int] = []
        for k, (u, v, c) in enumerate(edges):
            if c < 0 or not (0 <= u < n and 0 <= v < n):
                raise ValueError("edge outside the network or negative capacity")
            price = costs[k] if costs is not None else 0
            for a, b, room, p in ((u, v, c, price), (v, u, 0, -price)):
                self.out[a].append(len(self.to))
                self.to.append(b)
                self.left.append(room)
                self.cost.append(p)
            self.capacity.append(c)

    def flow(self, k: int) -> int:
        return self.capacity[k] - self.left[2 * k]

    def push(self, arcs: list[int]) -> int:
        amount = min(self.left[a] for a in arcs)
        for a in arcs:
            self.left[a] -= amount
            self.left[a ^ 1] += amount
        return amount

    def _search(self, s: int, t: int, depth_first: bool) -> list[int] | None:
        via, todo = {s: -1}, deque([s])
        while todo:
            u = todo.pop() if depth_first else todo.popleft()
            if u == t:
                arcs = []
                while via[u] >= 0:
                    arcs.append(via[u])
                    u = self.to[via[u] ^ 1]
                return arcs
            for a in self.out[u]:
                if self.left[a] > 0 and self.to[a] not in via:
                    via[self.to[a]] = a
                    todo.append(self.to[a])
        return None

    def augment(self, s: int, t: int, depth_first: bool = False) -> tuple[int, int]:
        """(max flow, augmenting paths): depth-first paths, or shortest ones."""
        total = paths = 0
        while s != t and (arcs := self._search(s, t, depth_first)):
            total += self.push(arcs)
            paths += 1
        return total, paths

    def blocking(self, s: int, t: int) -> tuple[int, int]:
        """(max flow, phases): a blocking flow per level graph."""
        total = phases = 0
        while s != t:
            level, todo = {s: 0}, deque([s])
            while todo:
                u = todo.popleft()
                for a in self.out[u]:
                    if self.left[a] > 0 and self.to[a] not in level:
                        level[self.to[a]] = level[u] + 1
                        todo.append(self.to[a])
            if t not in level:
                break
            phases += 1
            nxt = [0] * self.n
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    total += self.push(path)
                    path, u = [], s
                    continue
                while nxt[u] < len(self.out[u]):
                    a = self.out[u][nxt[u]]
                    if self.left[a] > 0 and level.get(self.to[a]) == level[u] + 1:
                        break
                    nxt[u] += 1
                if nxt[u] < len(self.out[u]):
                    path.append(self.out[u][nxt[u]])
                    u = self.to[path[-1]]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    nxt[u] += 1
                else:
                    break
        return total, phases

    def source_side(self, s: int) -> set[int]:
        """Vertices the residual network reaches from s: the source side of a minimum cut."""
        seen, todo = {s}, [s]
        for u in todo:
            for a in self.out[u]:
                if self.left[a] > 0 and self.to[a] not in seen:
                    seen.add(self.to[a])
                    todo.append(self.to[a])
        return seen

    def cheapest(self, s: int, t: int) -> tuple[int, int]:
        """(max flow, least cost) by cheapest paths; a negative cycle is an error."""
        total = price = 0
        while s != t:
            dist: list[float] = [float("inf")] * self.n
            via = [-1] * self.n
            dist[s] = 0
            for rounds in range(self.n + 1):
                changed = False
                for u in range(self.n):
                    if dist[u] == float("inf"):
                        continue
                    for a in self.out[u]:
                        if self.left[a] > 0 and dist[u] + self.cost[a] < dist[self.to[a]]:
                            dist[self.to[a]], via[self.to[a]], changed = dist[u] + self.cost[a], a, True
                if not changed:
                    break
                if rounds == self.n:
                    raise ValueError("negative cycle")
            if via[t] < 0:
                break
            arcs, u = [], t
            while u != s:
                arcs.append(via[u])
                u = self.to[via[u] ^ 1]
            amount = self.push(arcs)
            total += amount
            price += int(amount * dist[t])
        return total, price


def max_flow(n: int, edges, s: int, t: int, method: str = "dinic") -> tuple[int, int, Network]:
    net = Network(n, edges)
    if method == "dinic":
        return *net.blocking(s, t), net
    return *net.augment(s, t, depth_first=method == "ford-fulkerson"), net


def min_cut(n: int, edges, s: int, t: int) -> tuple[int, set[int], list[int]]:
    """(capacity, source side, crossing edge indexes)."""
    value, _, net = max_flow(n, edges, s, t)
    side = net.source_side(s)
    return value, side, [k for k, (u, v, _) in enumerate(edges) if u in side and v not in side]


def matching(left: Sequence, right: Sequence, edges: Sequence[tuple]) -> list[tuple]:
    """A largest set of disjoint (left, right) pairs, by left order."""
    li, ri = {x: i + 1 for i, x in enumerate(left)}, {y: len(left) + 1 + i for i, y in enumerate(right)}
    t = len(left) + len(right) + 1
    pairs = list(dict.fromkeys((a, b) for a, b in edges))
    arcs = [(0, i, 1) for i in li.values()] + [(li[a], ri[b], 1) for a, b in pairs] + [(i, t, 1) for i in ri.values()]
    net = Network(t + 1, arcs)
    net.blocking(0, t)
    chosen = [p for k, p in enumerate(pairs) if net.flow(len(left) + k)]
    return sorted(chosen, key=lambda p: li[p[0]])
