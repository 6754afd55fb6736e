"""Content-defined runs of windows: the pruning step of suffix-array dedup.

Every WIDTH-byte window is owned by the least hash of its GRAM-byte substrings. Consecutive windows with one owner form a
run. Equal windows have equal owners, so only runs that share an owner can hold equal windows; and two runs
are equal, window by window, if their first and last windows and their lengths are.
"""

from __future__ import annotations

import numpy as np

WIDTH, GRAM = 100, 16
SPAN = WIDTH - GRAM + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A fixed random number for each byte.
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * _A + right
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM-byte substrings and of the WIDTH-byte windows at each position of data (uint8)."""
    h = {1: _BYTE[data]}
    for k in (1, 2, 4, 8, 16, 32):
        h[2 * k] = _join(h[k][:-k], h[k][k:]) if len(h[k]) > k else h[k][:0]
        if k not in (4, 16, 32):
            del h[k]
    n = max(0, len(data) - WIDTH + 1)
    whole = _join(_join(h[64][:n], h[32][64 : 64 + n]), h[4][96 : 96 + n])
    return h[16], whole


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, identity, start, count): the runs of data's windows; count windows from start on. Arrays of one length."""
    none = np.zeros(0, dtype=np.uint64)
    if len(data) < WIDTH:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    gram, whole = window_hashes(data)
    least = gram
    k = 1
    while 2 * k <= SPAN:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    n = len(whole)
    least = np.minimum(least[:n], least[SPAN - k : SPAN - k + n])
    cut = np.ones(n, dtype=bool)
    # a new run where the least hash changes, or its place has just been left behind
    cut[1:] = (least[1:] != least[:-1]) | (gram[: n - 1] == least[:-1])
    start = np.flatnonzero(cut)
    count = np.diff(np.append(start, n))
    identity = _join(_join(whole[start], whole[start + count - 1]), count.astype(np.uint64))
    return least[start], identity, start, count
