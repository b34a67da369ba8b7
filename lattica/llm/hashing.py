"""Hashes of byte ranges over whole record batches, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import xxhash

VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint64)
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, remembered up to the longest asked for."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Spans:
    """Hashes of byte ranges: equal ranges have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[data] * powers(BASE, len(data)), dtype=np.uint64)])
        self.back = powers(UNBASE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind, broken at the texts' borders, without those of kind 0."""
    edge = np.ones(len(kinds) + 1, dtype=bool)
    edge[1:-1] = kinds[1:] != kinds[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kinds[starts] != 0 if len(starts) else np.zeros(0, bool)
    return starts[keep], ends[keep]
