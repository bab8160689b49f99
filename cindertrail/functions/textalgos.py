"""String algorithms in plain Python, called from Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

try:
    import ahocorasick
except ImportError:  # the automaton falls back to one search per pattern
    ahocorasick = None


def occurrences(text: str, pattern: str) -> list[int]:
    """Starts of all occurrences, overlaps included."""
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def border_array(pattern: str) -> list[int]:
    """Length of the longest proper prefix that is a suffix, for every prefix (the LPS table)."""
    border = [0] * len(pattern)
    k = 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = border[k - 1]
        k += pattern[i] == pattern[k]
        border[i] = k
    return border


def z_array(text: str) -> list[int]:
    """Length of the longest common prefix of the text and each of its suffixes; z[0] = 0."""
    n = len(text)
    z, lo, hi = [0] * n, 0, 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def hash_matches(text: str, pattern: str, base: int = 911382323, mods: Sequence[int] = (1_000_000_007,)) -> tuple[list[int], int]:
    """(starts, collisions) by rolling hashes; equal hashes are verified, so starts are exact."""
    m, n = len(pattern), len(text)
    if not m or m > n:
        return [], 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    want_codes = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).tolist()
    same = np.ones(n - m + 1, dtype=bool)
    for mod in mods:
        if mod >= 1 << 31:
            raise ValueError("moduli below 2^31")
        want, have, by = 0, np.zeros(n - m + 1, dtype=np.uint64), base % mod
        for i, c in enumerate(want_codes):
            want = (want * by + c) % mod
            have = (have * np.uint64(by) + codes[i : i + n - m + 1]) % np.uint64(mod)
        same &= have == want
    hits = np.flatnonzero(same).tolist()
    exact = [i for i in hits if text.startswith(pattern, i)]
    return exact, len(hits) - len(exact)


class Dictionary:
    """Every occurrence of every pattern: (start, pattern id), by end, longest first.

    A pattern given twice keeps its first id; empty patterns never match.
    """

    def __init__(self, patterns: Sequence[str]):
        self.ids: dict[str, int] = {}
        for i, p in enumerate(patterns):
            if p:
                self.ids.setdefault(p, i)
        self.machine = None
        if ahocorasick is not None and self.ids:
            self.machine = ahocorasick.Automaton()
            for p, i in self.ids.items():
                self.machine.add_word(p, (i, len(p)))
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        if self.machine is not None:
            found = [(end + 1, size, i) for end, (i, size) in self.machine.iter(text)]
        else:
            found = [(s + len(p), len(p), i) for p, i in self.ids.items() for s in occurrences(text, p)]
        return [(end - size, i) for end, size, i in sorted(found, key=lambda x: (x[0], -x[1]))]


def suffix_array(text: str) -> list[int]:
    """Suffix starts in lexicographic order, by prefix doubling over numpy ranks."""
    n = len(text)
    if n == 0:
        return []
    rank = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        if step < n:
            second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank[order] = new
        if new[-1] == n - 1:
            return order.tolist()
        step *= 2


def lcp_array(text: str, suffixes: Sequence[int]) -> list[int]:
    """Common prefix lengths of neighbours in suffix order; the first is 0."""
    n = len(text)
    if sorted(suffixes) != list(range(n)):
        raise ValueError("not a permutation of the suffix starts")
    place = [0] * n
    for r, s in enumerate(suffixes):
        place[s] = r
    lcp, k = [0] * n, 0
    for s in range(n):
        if place[s] == 0:
            k = 0
            continue
        o = suffixes[place[s] - 1]
        while s + k < n and o + k < n and text[s + k] == text[o + k]:
            k += 1
        lcp[place[s]] = k
        k = max(0, k - 1)
    return lcp


def edit_table(a: Sequence, b: Sequence, insert: int = 1, delete: int = 1, substitute: int = 1, swaps: bool = False) -> list[list[int]]:
    """Costs of turning prefixes of a into prefixes of b; ``swaps`` adds adjacent transpositions (OSA)."""
    t = [[j * insert for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        above, row = t[-1], [i * delete]
        for j, y in enumerate(b, 1):
            best = min(above[j] + delete, row[j - 1] + insert, above[j - 1] + (0 if x == y else substitute))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, t[i - 2][j - 2] + 1)
            row.append(best)
        t.append(row)
    return t


def edit_distance(a: Sequence, b: Sequence, insert: int = 1, delete: int = 1, substitute: int = 1, swaps: bool = False) -> int:
    if min(insert, delete, substitute) < 0:
        raise ValueError("costs must not be negative")
    return edit_table(a, b, insert, delete, substitute, swaps)[-1][-1]


def edit_script(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """MATCH x, SUBSTITUTE x y, DELETE x, INSERT y in order; ties prefer the earlier of these."""
    t, i, j, out = edit_table(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and t[i][j] == t[i - 1][j - 1]:
            out.append(f"MATCH {a[i - 1]}")
            i, j = i - 1, j - 1
        elif i and j and t[i][j] == t[i - 1][j - 1] + 1:
            out.append(f"SUBSTITUTE {a[i - 1]} {b[j - 1]}")
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + 1:
            out.append(f"DELETE {a[i - 1]}")
            i -= 1
        else:
            out.append(f"INSERT {b[j - 1]}")
            j -= 1
    return out[::-1]


def align(a: Sequence, b: Sequence, match: int = 1, mismatch: int = -1, gap: int = -1, local: bool = False) -> dict:
    """Best global or local alignment: score, columns (pairs with None for a gap), spans in a and b.

    Ties prefer the diagonal, then a gap in b, then a gap in a; the first best local end in
    reading order counts.
    """
    t = [[0 if local else j * gap for j in range(len(b) + 1)]]
    best, end = 0, (0, 0)
    for i, x in enumerate(a, 1):
        above, row = t[-1], [0 if local else i * gap]
        for j, y in enumerate(b, 1):
            s = max(above[j - 1] + (match if x == y else mismatch), above[j] + gap, row[j - 1] + gap)
            s = max(0, s) if local else s
            row.append(s)
            if local and s > best:
                best, end = s, (i, j)
        t.append(row)
    i, j = end if local else (len(a), len(b))
    score, stop, cols = t[i][j], (i, j), []
    while (i or j) and not (local and t[i][j] == 0):
        if i and j and t[i][j] == t[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            cols.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + gap:
            cols.append((a[i - 1], None))
            i -= 1
        else:
            cols.append((None, b[j - 1]))
            j -= 1
    cols.reverse()
    return {"score": score, "columns": cols, "a_from": i, "a_to": stop[0], "b_from": j, "b_to": stop[1]}


def identity_pct(columns: list[tuple]) -> int:
    """Share of columns with equal tokens; a gap is no token, whatever the tokens look like."""
    same = sum(x is not None and x == y for x, y in columns)
    return round(100 * same / len(columns)) if columns else 100
