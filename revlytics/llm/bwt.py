"""Burrows-Wheeler transforms of small string collections, merged by interleave refinement.

`Shard` sorts the suffixes of its own strings once. `merge` puts the transforms of several shards
together without sorting their suffixes again: it starts from all slots of shard 0, then 1, ...,
and refines this interleave; each round maps every slot back by its preceding byte (a stable
counting sort), after which the interleave is right for one byte more. Blocks of slots are carried
along: after k rounds a block holds the suffixes that share their first k bytes, which gives common
prefixes and repeated intervals as a by-product.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Suffix order and transform of strings, each ended by a sentinel that sorts first (by string number)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        m, n = len(size), int(offsets[-1]) + len(size)
        self.strings, self.n = m, n
        end = np.cumsum(size + 1) - 1
        whose = np.repeat(np.arange(m), size + 1)
        symbol = np.zeros(n + 8, np.uint64)
        inside = np.ones(n, bool)
        inside[end] = False
        symbol[:n][inside] = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
        rest = end[whose] - np.arange(n)  # symbols before the sentinel
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = key << np.uint64(9) | np.where(rest > k, symbol[k : n + k], np.uint64(0))
        order = np.argsort(key)
        rank = _ranks(key, order)
        h, longest = 7, int(size.max()) + 1 if m else 0
        while h < longest and rank[order[-1]] < n:
            ahead = np.zeros(n, np.int64)
            ok = np.flatnonzero(rest >= h)
            ahead[ok] = rank[ok + h]
            key = rank.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64)
            order = np.argsort(key)
            rank = _ranks(key, order)
            h *= 2
        order = np.argsort(rank * n + np.arange(n))  # equal suffixes by string number
        self.string = whose[order]
        self.at = (order - (end - size)[whose[order]]).astype(np.int64)
        first = np.zeros(n, bool)
        first[end - size] = True
        before = np.zeros(n, np.uint16)
        before[1:] = symbol[: n - 1].astype(np.uint16)
        before[first] = 0
        self.bwt = before[order]
        #: Where the suffix begins that is one symbol longer than each slot's.
        self.back = np.empty(n, np.int64)
        self.back[np.argsort(self.bwt, kind="stable")] = np.arange(n)


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    step = np.ones(len(order), np.int64)
    if len(order):
        step[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the merged transform in order: shard, string, position, and the block of suffixes sharing `depth` bytes."""
    if len(shards) > 256:
        raise ValueError("at most 256 shards are merged at once")
    base = np.cumsum([0, *(s.n for s in shards)])
    n, m = int(base[-1]), sum(s.strings for s in shards)
    symbols, bwt = np.unique(np.concatenate([s.bwt for s in shards]), return_inverse=True)
    bwt = bwt.astype(np.uint8 if len(symbols) <= 256 else np.uint16)
    back = np.concatenate([s.back + b for s, b in zip(shards, base)]).astype(np.int32)
    ends = np.concatenate([np.arange(s.strings) + b for s, b in zip(shards, base)]).astype(np.int32)
    source = np.arange(n, dtype=np.int32)  # the shards' slots, interleaved
    block = np.zeros(n, np.int32)
    start = np.ones(n, bool)
    for _ in range(depth):
        c = bwt[source]
        order = np.argsort(c, kind="stable")
        c, b = c[order], block[order]
        start[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        start[: m + 1] = True  # sentinels never match one another
        source = back[source[order]]
        source[:m] = ends
        block = np.cumsum(start, dtype=np.int32)
    string = np.concatenate([s.string for s in shards])[source]
    at = np.concatenate([s.at for s in shards])[source]
    return (np.searchsorted(base, source, side="right") - 1).astype(np.int64), string, at, block
