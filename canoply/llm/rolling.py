"""Rolling hashes of byte strings in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


class Roller:
    """Hashes of substrings: sums of byte codes times powers of an odd number, modulo 2**64."""

    def __init__(self, most: int):
        rng = np.random.default_rng(20240229)
        self.codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        base = 0x5851F42D4C957F2D
        powers = [np.full(most, v, np.uint64) for v in (base, pow(base, -1, 1 << 64))]
        for p in powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        self.power, self.inverse = powers

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.power[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, lo, hi) -> np.ndarray:
        return mix((sums[hi] - sums[lo]) * self.inverse[lo])

    def all(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Of every substring of n bytes."""
        k = len(sums) - n
        return mix((sums[n:] - sums[:k]) * self.inverse[:k]) if k > 0 else np.empty(0, np.uint64)
