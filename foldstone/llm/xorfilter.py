"""Immutable fingerprint filters built by peeling.

A filter over n distinct 64-bit hashes has three blocks of cells, 1.23 n in all, and each hash owns
one cell in each block. Cells that a single hash owns are peeled off, round after round, until no
hash is left; then, in reverse order, each hash's own cell gets the value that makes the xor of its
three cells equal its fingerprint. A member is always found; a stranger is found with probability
2**-16. Building and probing are whole-array operations.
"""

from __future__ import annotations

import numpy as np

BITS = 16
#: Probability that one filter takes a stranger for a member.
FALSE_POSITIVE = 2.0**-BITS
_SLACK, _MIN_CELLS = 1.23, 32


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def _places(h: np.ndarray, seed: int, block: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The three cells of each hash, and its fingerprint."""
    x, y = _mix(h, seed), _mix(h, seed + 1_000_003)
    low, n = np.uint64(0xFFFFFFFF), np.uint64(block)
    parts = (x & low, x >> np.uint64(32), y & low)
    cells = [((p * n) >> np.uint64(32)).astype(np.int64) + i * block for i, p in enumerate(parts)]
    return cells, (y >> np.uint64(48)).astype(np.uint16)


def build(hashes: np.ndarray) -> tuple[int, bytes]:
    """``(seed, cells)`` of the filter over ``hashes`` (int64; repeated ones count once)."""
    h = np.unique(hashes.astype(np.int64)).view(np.uint64)
    block = (int(_SLACK * len(h)) + _MIN_CELLS) // 3 + 1
    for seed in range(1, 1000):
        cells, prints = _places(h, seed, block)
        order = _peel(cells, len(h), 3 * block)
        if order is None:
            continue
        table = np.zeros(3 * block, np.uint16)
        for keys, own in reversed(order):
            # no other hash of this round owns these cells, so the round is filled at once
            table[own] = 0
            table[own] = prints[keys] ^ table[cells[0][keys]] ^ table[cells[1][keys]] ^ table[cells[2][keys]]
        return seed, table.tobytes()
    raise RuntimeError("no seed peels these hashes")


def _peel(cells: list[np.ndarray], n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (hashes, own cells), or None if some hashes can't be peeled."""
    count = sum(np.bincount(c, minlength=size) for c in cells)
    index = np.arange(n, dtype=np.float64)
    total = sum(np.bincount(c, weights=index, minlength=size) for c in cells).astype(np.int64)
    rounds, left = [], n
    ready = np.flatnonzero(count == 1)
    while len(ready):
        keys, first = np.unique(total[ready], return_index=True)
        rounds.append((keys, ready[first]))
        left -= len(keys)
        for c in cells:
            np.subtract.at(count, c[keys], 1)
            np.subtract.at(total, c[keys], keys)
        touched = np.unique(np.concatenate([c[keys] for c in cells]))
        ready = touched[count[touched] == 1]
    return None if left else rounds


def contains(seed: int, cells: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether the filter may hold it."""
    table = np.frombuffer(cells, np.uint16)
    (a, b, c), prints = _places(hashes.astype(np.int64).view(np.uint64), seed, len(table) // 3)
    return table[a] ^ table[b] ^ table[c] == prints


def compounded(filters: int) -> float:
    """Probability that at least one of so many filters takes a stranger for a member."""
    return -np.expm1(filters * np.log1p(-FALSE_POSITIVE))
