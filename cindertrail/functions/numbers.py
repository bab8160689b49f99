"""Randomised number algorithms and hashing structures."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

MERSENNE = 2**61 - 1
#: Bases that decide primality of every number below 2^64.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def is_prime(n: int, witnesses: Sequence[int] = WITNESSES) -> bool:
    """Exact below 2^64."""
    if n < 2:
        return False
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in witnesses:
        x = pow(a % n, d, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def probably_prime(n: int, rounds: int = 20) -> bool:
    if n < 4:
        return n in (2, 3)
    rng = random.Random(n ^ 0x5EED)
    return n % 2 == 1 and is_prime(n, [rng.randrange(2, n - 1) for _ in range(rounds)])


def reservoir(stream: Iterable, k: int, seed: int = 42) -> list:
    """k items of a stream, each equally likely, in slot order."""
    rng, kept = random.Random(seed), []
    for i, x in enumerate(stream):
        if i < k:
            kept.append(x)
        elif (j := rng.randrange(i + 1)) < k:
            kept[j] = x
    return kept


def text_key(text: str) -> int:
    """Polynomial key of a text, base 131, wrapping in 64 bits."""
    h = 0
    for c in text:
        h = (h * 131 + ord(c)) & (2**64 - 1)
    return h - 2**64 if h >= 2**63 else h


def family(seed: int) -> tuple[int, int]:
    """(a, b) of one member of the universal family."""
    rng = random.Random(seed)
    return rng.randrange(1, MERSENNE), rng.randrange(MERSENNE)


class PerfectHash:
    """Two-level static table of distinct keys: no collisions, linear space."""

    def __init__(self, keys: Sequence[int], seed: int = 1337, tries: int = 128):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.m, self.rng = max(1, len(keys)), random.Random(seed)
        for _ in range(tries):
            self.top = self._draw()
            rows: list[list[int]] = [[] for _ in range(self.m)]
            for x in keys:
                rows[self._slot(self.top, x, self.m)].append(x)
            if sum(len(r) ** 2 for r in rows) <= 4 * self.m:
                break
        else:
            raise RuntimeError("no first-level function found")
        self.rows = [self._row(r, tries) for r in rows]

    def _draw(self) -> tuple[int, int]:
        return self.rng.randrange(1, MERSENNE), self.rng.randrange(MERSENNE)

    @staticmethod
    def _slot(ab: tuple[int, int], x: int, m: int) -> int:
        return (ab[0] * (x % MERSENNE) + ab[1]) % MERSENNE % m

    def _row(self, keys: list[int], tries: int):
        size = len(keys) ** 2
        for _ in range(tries * 8):
            ab, cells = self._draw(), [None] * size
            for x in keys:
                i = self._slot(ab, x, size)
                if cells[i] is not None:
                    break
                cells[i] = x
            else:
                return ab, cells
        raise RuntimeError("no second-level function found")

    def __contains__(self, x: int) -> bool:
        ab, cells = self.rows[self._slot(self.top, x, self.m)]
        return bool(cells) and cells[self._slot(ab, x, len(cells))] == x


def split_mix(seed: int, steps: int = 1) -> int:
    """The ``steps``-th number of the 64-bit mixing generator, as a signed long."""
    mask = 2**64 - 1
    z = (seed + steps * 0x9E3779B97F4A7C15) & mask
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
    z ^= z >> 31
    return z - 2**64 if z >= 2**63 else z
