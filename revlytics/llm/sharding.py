"""Minimax contiguous sharding.

Atomic groups (equal texts, by 64-bit content hash) are laid out in hash order; the smallest capacity
that lets `shards` contiguous runs hold them all is found by binary search with a greedy check, and
the runs are cut there. Copies of a text therefore always share a shard, and no other contiguous cut
has a smaller largest shard.

The driver never sees the groups. It holds sums over hash ranges: 2^16 first, and only ranges in
which a cut can still fall are split further, 256-fold, until those are single groups. The number of
ranges depends on `shards`, not on the data. Within the capacity found, cuts are placed nearest to
even sizes, so that a very large group doesn't leave shards empty.

Nulls count as empty texts (size `overhead`), an empty table gives an empty result, repeated rows get
a slot each, ties in doc_id are broken by size, hash and the number that a row gets as it is written: by that number
rows alike, and rows without an id, are dealt out to blocks like any others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlytics.llm.common import stage, table

TOP_BITS, STEP_BITS = 16, 8
#: Rows that one task numbers; more rows give more blocks.
BLOCK_ROWS = 50_000


def sized(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


class _Ranges:
    """Hash ranges in key order: first key, key shift, bytes, whether a single group."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.start = np.array([r[0] for r in rows], np.int64)
        self.shift = np.array([r[1] for r in rows], np.int64)
        self.size = np.array([r[2] for r in rows], np.int64)
        self.single = np.array([r[3] for r in rows], bool)
        self.ends = np.cumsum(self.size)

    def rows(self, keep):
        return list(zip(self.start[keep].tolist(), self.shift[keep].tolist(), self.size[keep].tolist(), self.single[keep].tolist()))

    def greedy(self, capacity: int, shards: int, fluid: bool = False) -> list[int] | None:
        """Bytes before each cut when every shard takes all it can; None if some bytes remain. fluid: ranges of several groups may be cut anywhere."""
        cuts, at, total = [], 0, int(self.ends[-1])
        for _ in range(shards):
            if at >= total:
                break
            i = int(np.searchsorted(self.ends, at + capacity, side="right"))
            end = int(self.ends[i - 1]) if i else 0
            if fluid and i < len(self.ends) and not self.single[i]:
                end = at + capacity
            if end <= at:
                return None
            cuts.append(end)
            at = end
        return cuts if at >= total else None

    def smallest(self, shards: int, fluid: bool = False) -> int:
        total = int(self.ends[-1])
        most = int(self.size[self.single].max()) if fluid and self.single.any() else 0 if fluid else int(self.size.max())
        low, high = max(-(-total // shards), most), total
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, fluid) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Indexes of the ranges that begin shards 1.., as near to even sizes as the capacity allows."""
        n, total = len(self.size), int(self.ends[-1])
        before = np.concatenate([[0], self.ends])
        first = [n]  # earliest index from which k shards hold the rest
        for _ in range(shards):
            first.append(int(np.searchsorted(before, before[first[-1]] - capacity, side="left")))
        cuts, at = [], 0
        for k in range(1, shards):
            left = shards - k
            low, high = max(min(at + 1, n), first[left]), int(np.searchsorted(before, before[at] + capacity, side="right")) - 1
            want = before[at] + (total - before[at]) / (left + 1)
            i = int(np.searchsorted(before, want))
            if i > 0 and want - before[i - 1] <= before[min(i, n)] - want:
                i -= 1
            at = min(max(i, low), high)
            cuts.append(at)
        return cuts


def _sums(base: DataFrame, shift: int) -> DataFrame:
    part = F.shiftright("key", shift).alias("part")
    return base.groupBy(part).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))


def cut_keys(base: DataFrame, shards: int) -> tuple[list[int], int]:
    """The first key of each of shards 1.., and the capacity."""
    spark = base.sparkSession
    shift = 64 - TOP_BITS
    got = [(r["part"] << shift, shift, r["size"], r["low"] == r["high"]) for r in _sums(base, shift).toLocalIterator()]
    if not got:
        return [], 0
    while True:
        ranges = _Ranges(got)
        high = ranges.smallest(shards)
        low = ranges.smallest(shards, fluid=True)
        slow, fast = ranges.greedy(low, shards) or _partial(ranges, low, shards), ranges.greedy(high, shards, fluid=True)
        open_ = np.zeros(len(ranges.size), bool)
        before = ranges.ends - ranges.size
        for k in range(len(fast)):
            a = slow[k] if k < len(slow) else slow[-1] if slow else 0
            open_ |= (ranges.ends >= min(a, fast[k])) & (before <= max(a, fast[k]))
        open_ &= ~ranges.single
        if not open_.any() or shift == 0:
            return [int(ranges.start[i]) if i < len(ranges.start) else None for i in ranges.even_cuts(high, shards)], high
        split = {s: ranges.start[open_ & (ranges.shift == s)] >> s for s in np.unique(ranges.shift[open_]).tolist()}
        got = ranges.rows(~open_)
        for s, parts in split.items():  # at most one entry for each depth
            shift = max(0, s - STEP_BITS)
            wanted = F.broadcast(spark.createDataFrame([(int(p),) for p in parts], "wanted long"))  # bounded by shards, not by rows
            inner = base.join(wanted, F.shiftright("key", s) == F.col("wanted"), "left_semi")
            got += [(r["part"] << shift, shift, r["size"], r["low"] == r["high"]) for r in _sums(inner, shift).toLocalIterator()]


def _partial(ranges: _Ranges, capacity: int, shards: int) -> list[int]:
    """Greedy cuts as far as they go: a lower bound of each cut."""
    cuts, at = [], 0
    for _ in range(shards):
        i = int(np.searchsorted(ranges.ends, at + capacity, side="right"))
        at = max(at, int(ranges.ends[i - 1]) if i else 0)
        cuts.append(at)
    return cuts


def minimax_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: see the module's text."""
    base = stage(sized(docs, id_col, text_col, overhead), "sized")
    keys, _ = cut_keys(base, shards)
    shard = F.lit(0)
    for k in keys:
        shard = shard + (F.lit(0) if k is None else (F.col("key") >= F.lit(k)).cast("int"))
    blocks = max(64, base.count() // (shards * BLOCK_ROWS))
    placed = base.withColumn("shard", shard).withColumn("block", F.pmod(F.xxhash64("doc_id", "key", "row"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "key", "row")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place")).alias("slot"))
    )


def op1_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    out = minimax_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
