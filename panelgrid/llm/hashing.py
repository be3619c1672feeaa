"""Vectorised hashes of stretches of bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of stretches of bytes, from sums of bytes times powers of an odd base."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """What ``between`` reads, for several calls on one text."""
        if len(self.up) <= len(raw):
            self.up, self.down = powers(BASE, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)], out=total[1:])
        return total

    def between(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((total[end] - total[start]) * self.down[start])

    def stretches(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.between(self.sums(raw), start, end)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by spans that double as long as they fit."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least
