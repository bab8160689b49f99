"""Covers: approximations, exact bounded search, kernels and reductions on one graph each."""

from __future__ import annotations

from collections.abc import Sequence


def matched_edges(edges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """A maximal matching, greedy in edge order; loops are passed over."""
    used: set[int] = set()
    out = []
    for u, v in edges:
        if u != v and u not in used and v not in used:
            used |= {u, v}
            out.append((u, v))
    return out


def vertex_cover(edges: Sequence[tuple[int, int]]) -> list[int]:
    """A cover of at most twice the least size: vertices with loops, then the ends of a maximal matching."""
    forced = {u for u, v in edges if u == v}
    rest = [(u, v) for u, v in edges if u not in forced and v not in forced]
    return sorted(forced.union(*matched_edges(rest)) if rest else forced)


def set_cover(universe: Sequence, sets: Sequence[Sequence]) -> tuple[list[int], list]:
    """(chosen set indexes, what stays uncovered): largest gain first, ties to the lowest index."""
    left, chosen = set(universe), []
    members = [set(s) for s in sets]
    while left:
        best = max(range(len(members)), key=lambda i: (len(members[i] & left), -i), default=None)
        if best is None or not members[best] & left:
            break
        chosen.append(best)
        left -= members[best]
    return chosen, sorted(left)


def kernel(edges: Sequence[tuple[int, int]], k: int) -> tuple[list[int], list[tuple[int, int]], int] | None:
    """(forced vertices, edges left, k left) after the loop and high-degree rules; None if no cover of k exists."""
    forced: list[int] = []
    rest = list(dict.fromkeys((min(e), max(e)) for e in edges))
    while True:
        pick = next((u for u, v in rest if u == v), None)
        if pick is None:
            degree: dict[int, int] = {}
            for u, v in rest:
                degree[u] = degree.get(u, 0) + 1
                degree[v] = degree.get(v, 0) + 1
            pick = next((x for x in sorted(degree) if degree[x] > k), None)
        if pick is None:
            break
        forced.append(pick)
        k -= 1
        if k < 0:
            return None
        rest = [e for e in rest if pick not in e]
    return None if len(rest) > k * k else (forced, rest, k)


def bounded_cover(edges: Sequence[tuple[int, int]], k: int) -> list[int] | None:
    """A cover of at most k vertices, or None, branching over the ends of an uncovered edge."""
    if not edges:
        return []
    if k == 0:
        return None
    u, v = edges[0]
    for pick in dict.fromkeys((u, v)):
        found = bounded_cover([e for e in edges if pick not in e], k - 1)
        if found is not None:
            return sorted([pick, *found])
    return None


def smallest_cover(edges: Sequence[tuple[int, int]], least: int, size: int, most: int = 20) -> int | None:
    """The size of a smallest cover, known to lie in least..size; None if it takes a search over more than ``most`` vertices."""
    for k in range(least, size + 1):
        reduced = kernel(edges, k)
        if reduced is None:
            continue
        if reduced[2] > most and reduced[1]:
            return None
        if bounded_cover(reduced[1], reduced[2]) is not None:
            return k
    return size


def complement_edges(n: int, edges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    have = {(min(e), max(e)) for e in edges}
    return [(u, v) for u in range(n) for v in range(u + 1, n) if (u, v) not in have]


def is_cover(chosen: set[int], edges: Sequence[tuple[int, int]]) -> bool:
    return all(u in chosen or v in chosen for u, v in edges)


def is_independent(chosen: set[int], edges: Sequence[tuple[int, int]]) -> bool:
    return all(not (u in chosen and v in chosen) for u, v in edges)


def is_clique(chosen: set[int], n: int, edges: Sequence[tuple[int, int]]) -> bool:
    return is_independent(chosen, [e for e in complement_edges(n, edges)])
