"""Best-fit packing of documents into token sequences by linear grouping.

The plan is made from the histogram of piece lengths alone, which has at most `capacity` entries
whatever the number of documents:

1. large lengths, in falling order, are dealt into groups of equal cardinality and rounded up to their group's longest;
2. for these few sizes the fractional configuration programme is solved by column generation (a
   knapsack prices new configurations) and rounded down;
3. actual lengths, longest first, take the places of their group;
4. what is left over and all small lengths go, longest first, to the fullest sequence that still holds them (best fit).

Several group counts are tried, also with poorly filled configurations dissolved before step 4; the
plan with the fewest sequences is taken.

A plan is a list of patterns with repetitions. Documents are then numbered within their length (in
blocks, so that no task holds all documents of a length) and looked up in it.

Null texts count as empty: one token. Repeated rows are separate documents; an empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlytics.llm.bpe import vocabulary_path, with_ids
from revlytics.llm.common import stage, table

#: Rows that one task numbers.
BLOCK_ROWS = 50_000


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes that fits (knapsack over whole capacities)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for k, s in enumerate(sizes):
        for _ in range(capacity // s if worth[k] > 1e-12 else 0):
            more = best[:-s] + worth[k]
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, more, best[s:])
            took[s:][better] = k
    config, c = np.zeros(len(sizes)), int(np.argmax(best))
    while c > 0 and took[c] >= 0:  # a later size may have raised an earlier filling: worth more, and still fits
        config[took[c]] += 1
        c -= sizes[took[c]]
    return config


def configurations(sizes: list[int], demand: list[int], capacity: int, most_steps: int = 400) -> list[tuple[np.ndarray, float]]:
    """The fractional programme: (copies of each size, how often), by column generation with a revised simplex."""
    n = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.linalg.inv(columns)
    level = inverse @ np.array(demand, float)
    for _ in range(most_steps):
        prices = inverse.sum(axis=0)
        config = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if config @ prices <= 1 + 1e-7 or config @ np.array(sizes) > capacity:
            break
        step = inverse @ config
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, level / np.where(ok, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = config
        level = level - ratio[out] * step
        level[out] = ratio[out]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, k].copy(), float(max(0.0, level[k]))) for k in range(n) if level[k] >= 1]


class _Bins:
    """Open sequences by free space: patterns (tuples of lengths) and how many there are of each."""

    def __init__(self, capacity: int):
        self.capacity, self.space, self.held = capacity, [], {}

    def add(self, pattern: tuple, n: int) -> None:
        if n <= 0:
            return
        free = self.capacity - sum(pattern)
        if free not in self.held:
            self.held[free] = {}
            bisect.insort(self.space, free)
        self.held[free][pattern] = self.held[free].get(pattern, 0) + n

    def place(self, length: int, n: int) -> None:
        """Best fit of n pieces: into the least space that holds one, else into new sequences."""
        while n:
            i = bisect.bisect_left(self.space, length)
            if i == len(self.space):
                free, pattern, there = self.capacity, (), -(-n // (self.capacity // length))
            else:
                free = self.space[i]
                pattern, there = next(iter(self.held[free].items()))
                del self.held[free][pattern]
                if not self.held[free]:
                    del self.held[free], self.space[i]
            each = free // length
            full = min(there, n // each)
            self.add(pattern + (length,) * each, full)
            n -= full * each
            there -= full
            if there and n:
                self.add(pattern + (length,) * n, 1)
                n, there = 0, there - 1
            if pattern:
                self.add(pattern, there)

    def patterns(self) -> list[tuple[tuple, int]]:
        return [(p, n) for free in self.held.values() for p, n in free.items()]


#: Numbers of groups and free tokens up to which a configuration's sequence is kept; its pieces are packed by best fit otherwise.
TRIES = ((24, 2048), (24, 16), (64, 2048), (64, 16), (64, 2), (160, 2048), (160, 8))


def best_patterns(histogram: dict[int, int], capacity: int = 2048, tries=TRIES, large: float = 0.125) -> list[tuple[tuple, int]]:
    """The plan with the fewest sequences over several group counts; planning costs the same for any number of documents."""
    plans = [plan_patterns(histogram, capacity, g, large, free) for g, free in tries]
    return min(plans, key=lambda p: sum(n for _, n in p))


def plan_patterns(histogram: dict[int, int], capacity: int = 2048, groups: int = 24, large: float = 0.125, keep_free: int = 2048) -> list[tuple[tuple, int]]:
    """Patterns (lengths in a sequence) and how often each is used; together they take every piece of the histogram."""
    left = {s: n for s, n in histogram.items() if n > 0}
    bins = _Bins(capacity)
    bins.add((capacity,), left.pop(capacity, 0))
    big = sorted((s for s in left if s > large * capacity), reverse=True)
    total, loose = sum(left[s] for s in big), {}
    if total >= groups:
        each, dealt, at = -(-total // groups), [], 0
        queue = [[s, left[s]] for s in big]
        while at < len(queue):
            room, group = each, []
            while room and at < len(queue):
                take = min(room, queue[at][1])
                group.append([queue[at][0], take])
                queue[at][1] -= take
                room -= take
                at += queue[at][1] == 0
            if dealt and dealt[-1][0][0] == group[0][0]:  # rounded up to the same length: one size of the programme
                dealt[-1] += group
            else:
                dealt.append(group)
        sizes = [g[0][0] for g in dealt]
        demand = [sum(n for _, n in g) for g in dealt]
        for config, often in configurations(sizes, demand, capacity):
            often = int(often + 1e-6)
            slots = [k for k in range(len(sizes)) for _ in range(int(round(config[k])))]
            while often and slots:
                # As many sequences alike as every slot's current length lasts.
                now, ask = [], {}
                for k in slots:
                    ask[k] = ask.get(k, 0) + 1
                if any(sum(n for _, n in dealt[k]) < c for k, c in ask.items()):
                    break
                for k, c in ask.items():
                    run = dealt[k]
                    need, i = c, 0
                    while need:
                        take = min(need, run[i][1])
                        now += [(k, i, run[i][0])] * take
                        need -= take
                        i += 1
                used = {}
                for k, i, _ in now:
                    used[k, i] = used.get((k, i), 0) + 1
                times = min([often, *(dealt[k][i][1] // c for (k, i), c in used.items())])
                for (k, i), c in used.items():
                    dealt[k][i][1] -= c * times
                for k in ask:
                    dealt[k] = [r for r in dealt[k] if r[1]]
                pattern = tuple(sorted((s for _, _, s in now), reverse=True))
                if capacity - sum(pattern) <= keep_free:
                    bins.add(pattern, times)
                else:
                    for s in pattern:
                        loose[s] = loose.get(s, 0) + times
                often -= times
        for s in big:
            del left[s]
        for group in dealt:
            for s, n in group:
                left[s] = left.get(s, 0) + n
        for s, n in loose.items():
            left[s] = left.get(s, 0) + n
    for s in sorted(left, reverse=True):
        bins.place(s, left[s])
    return bins.patterns()


@dataclass(frozen=True)
class Plan:
    """Look-up of a piece by length and number: sorted keys, first number, copies in a pattern, first sequence, offset."""

    key: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length.astype(np.int64) << 44 | rank, side="right") - 1
        t = rank - self.first[i]
        return self.sequence[i] + t // self.copies[i], self.offset[i] + t % self.copies[i] * length


def make_plan(histogram: dict[int, int], capacity: int = 2048, **options) -> Plan:
    rows, done, base = [], {}, 0
    for pattern, times in sorted(best_patterns(histogram, capacity, **options)):
        at = 0
        for s in sorted(set(pattern), reverse=True):
            copies = pattern.count(s)
            first = done.get(s, 0)
            rows.append((s << 44 | first, first, copies, base, at))
            done[s] = first + copies * times
            at += copies * s
        base += times
    rows.sort()
    return Plan(*(np.array([r[k] for r in rows], np.int64) for k in range(5)), base)


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut only where longer than capacity."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], np.uint32).tobytes()

    def cut(doc_ids: pa.Array, coded: list[bytes], _) -> dict:
        which, piece, start, length, crc = [], [], [], [], []
        for n, ids in enumerate(coded):
            ids += end
            for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[a : a + 4 * capacity]
                which.append(n)
                piece.append(p)
                start.append(a // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        wide = {c: pa.array(x, pa.int64()) for c, x in (("start", start), ("length", length), ("ids_crc32", crc))}
        return {"doc_id": doc_ids.take(pa.array(which, pa.int64())), "piece": pa.array(piece, pa.int32())} | wide

    return with_ids(docs, path, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", id_col, text_col)


def pack(pieces: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """The pieces with sequence_id and offset. Rows are numbered as they are written, so that rows alike are dealt out too."""
    names, pieces = pieces.columns, stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}  # at most `capacity` rows
    plan = make_plan(counts, capacity, **options)
    blocks = max(16, sum(counts.values()) // BLOCK_ROWS)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["length", "block"])
    ranked = ranked.select(*names, (F.col("begin") + F.col("place")).alias("rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # its size depends on the capacity, not on the documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            seq, off = held.look_up(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, kinds + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces_of(docs, path, capacity, end_id, id_col, text_col), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
