"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """Strings end to end, each with a terminator 0 behind it and bytes as 1 to 256; `order` sorts all rotations by `depth` symbols or
    more, and `bwt` is the symbol before each."""

    symbols: np.ndarray
    first: np.ndarray  # where each symbol's string starts
    size: np.ndarray  # its string's length, terminator included
    order: np.ndarray
    bwt: np.ndarray

    @classmethod
    def build(cls, strings: list[bytes], depth: int) -> Shard:
        lengths = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        starts = np.append(0, np.cumsum(lengths))[:-1]
        symbols = np.zeros(int(lengths.sum()), dtype=np.uint16)
        body = np.ones(len(symbols), dtype=bool)
        body[starts + lengths - 1] = False
        symbols[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1
        first, size = np.repeat(starts, lengths), np.repeat(lengths, lengths)
        inside = np.arange(len(symbols)) - first
        # prefix doubling: ranks by k symbols give ranks by 2k
        rank, k = symbols.astype(np.int64), 1
        while k < depth:
            key = rank * (int(rank.max(initial=0)) + 1) + rank[first + (inside + k) % size]
            rank, k = np.unique(key, return_inverse=True)[1], 2 * k
        order = np.argsort(rank, kind="stable")
        before = symbols[first + (inside - 1) % size]
        return cls(symbols, first, size, order, before[order])


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix in the merged order, common prefix with the suffix before it, `depth` where it is at least that).

    The interleave starts with the shards one after another, sorted by no symbol. Each round passes through the shards' transforms in
    the current interleave and deals its entries stably by symbol: that sorts by one symbol more. A border between
    two neighbours that first shows in round h means a common prefix of h - 1. The suffixes themselves are never sorted again.
    """
    n = sum(len(s.bwt) for s in shards)
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.bwt) for s in shards])
    block = np.zeros(n, dtype=np.int32)
    common = np.full(n, depth, dtype=np.int32)
    symbol = np.empty(n, dtype=np.uint16)
    if n:
        common[0] = 0
    for h in range(1, depth + 1):
        for k, s in enumerate(shards):
            symbol[which == k] = s.bwt
        deal = np.argsort(symbol, kind="stable")
        which, dealt, blocks = which[deal], symbol[deal], block[deal]
        border = np.empty(n, dtype=bool)
        border[:1] = True
        border[1:] = (dealt[1:] != dealt[:-1]) | (blocks[1:] != blocks[:-1])
        common[border & (common == depth)] = h - 1
        block = np.cumsum(border, dtype=np.int32)
    return which, common


def repeated(strings: list[bytes], width: int, shard_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, position, interval) of each `width`-byte substring that occurs more than once; equal ones share an interval."""
    groups: list[list[int]] = [[]]
    size = 0
    for k, s in enumerate(strings):
        if size >= shard_bytes and len(groups) < 255:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(s) + 1
    shards = [Shard.build([strings[k] for k in g], width) for g in groups]
    which, common = merge(shards, width)
    string, place, left = np.empty(len(which), dtype=np.int64), np.empty(len(which), dtype=np.int64), np.empty(len(which), dtype=np.int64)
    for k, (g, s) in enumerate(zip(groups, shards, strict=True)):
        own = which == k
        at = s.order
        ids = np.repeat(np.array(g, dtype=np.int64), [len(strings[x]) + 1 for x in g])
        string[own], place[own] = ids[at], at - s.first[at]
        left[own] = s.size[at] - 1 - place[own]
    interval = np.cumsum(common < width)
    whole = left >= width
    string, place, interval = string[whole], place[whole], interval[whole]
    often = np.bincount(interval)[interval] > 1 if len(interval) else np.zeros(0, dtype=bool)
    return string[often], place[often], interval[often]
