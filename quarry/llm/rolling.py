"""Polynomial hashes of stretches of a sequence, modulo 2 ** 64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=32)
def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and of its inverse."""
    powers, inverse = np.full(n, np.uint64(BASE)), np.full(n, np.uint64(pow(BASE, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of ``values`` (64-bit hashes of the elements) from running sums."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        powers, self.inverse = power_table(1 << self.n.bit_length())
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(values) * powers[: self.n], out=self.total[1:])

    def windows(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` elements."""
        return mixed((self.total[size:] - self.total[:-size]) * self.inverse[: self.n - size + 1])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the stretches [start, end)."""
        return mixed((self.total[end] - self.total[start]) * self.inverse[start])
