"""SimHash near-duplicates with bit-sliced comparison.

1. Every whole text gives a fingerprint: for each bit, whether over half of its shingles' hashes have it.
2. Distinct fingerprints are dealt into buckets. For a small radius r the bits are cut into r + 1
   blocks: two fingerprints within r agree on one block at least, so nothing is lost. A bucket
   that is too large is cut again by the remaining bits in the same way.
3. Within a bucket fingerprints are compared bit-sliced: bit planes are stored vertically, one bit of
   many fingerprints a word; the planes' differences are added three at a time by carry-save
   adders into bitwise counters, and a query is abandoned once all lanes exceed the radius.
4. A bucket emits a spanning forest of its links, not its pairs; connected components of all forests
   are the groups.

Buckets that stay large are compared as pairs of sub-blocks, so no task holds more than about
`BUCKET` fingerprints. Copies share a fingerprint and cost one row.
Null and empty texts, and texts without words, have fingerprint zero and are linked like any other.
Repeated rows give equal rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import at, discard, slices, stage, table, utf8
from revlytics.llm.components import connected_components

BUCKET = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, lower-cased and joined by spaces; of all words where there are fewer."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(found) - words + 1)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(begin[:n].tolist(), end[min(words, len(found)) - 1 :].tolist())], np.uint64)


def _wide(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of `bits` bits from 64-bit ones, as rows of words."""
    out = [h]
    with np.errstate(over="ignore"):
        for k in range(1, bits // 64):
            x = h + np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprints_of(texts: list[bytes], words: int, bits: int) -> np.ndarray:
    """A row of bits // 64 words for each text."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    hashes = [shingle_hashes(t, words) for t in texts]
    filled = [i for i, h in enumerate(hashes) if len(h)]
    step = 1 << 15
    for i in filled:
        h, total = hashes[i], np.zeros(bits, np.int64)
        for a in range(0, len(h), step):
            wide = _wide(h[a : a + step], bits)
            total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)
    return out


def majorities(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit fingerprints (bytes, least first) of texts given by their hashes, `count` of each text one after another."""
    out = np.zeros((len(count), 8), np.uint8)
    filled = np.flatnonzero(count)
    if len(filled):
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(count) - count)[filled]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[filled] = np.packbits(2 * ones > count[filled][:, None], axis=1, bitorder="little")
    return out


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary, least significant byte first)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                got = fingerprints_of([data[offsets[n] : offsets[n + 1]].tobytes() for n in range(i, j)], words, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([r.tobytes() for r in got], pa.binary())], ["doc_id", "fp"])

    source = docs.select(at(id_col).alias("doc_id"), at(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, fp binary")


# ---- comparison in a bucket


def close_pairs(bits: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i within the radius) for each row i of a 0/1 matrix that has any."""
    n, width = bits.shape
    lanes = -(-n // 64)
    padded = np.zeros((width, lanes * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    ask = np.where(bits.astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    depth = max(2, int(radius).bit_length())
    for start in range(0, n, rows):
        q = np.arange(start, min(n, start + rows))
        out = np.ones((len(q), lanes * 64), np.uint8)  # lanes no longer in question: at first j <= i and padding
        for k, i in enumerate(q):
            out[k, i + 1 : n] = 0
        over = np.packbits(out, axis=1, bitorder="little").view(np.uint64)
        lane0 = start // 64  # earlier lanes hold j <= i only
        over = over[:, lane0:]
        count = [np.zeros_like(over) for _ in range(depth)]
        for p in range(0, width, 3):
            a = planes[p, lane0:][None, :] ^ ask[q, p][:, None]
            if p + 2 < width:
                b = planes[p + 1, lane0:][None, :] ^ ask[q, p + 1][:, None]
                c = planes[p + 2, lane0:][None, :] ^ ask[q, p + 2][:, None]
                half = a ^ b
                ones, twos = half ^ c, (a & b) | (c & half)
                over |= _add(count, twos, 1)
            else:
                ones = a
                if p + 1 < width:
                    over |= _add(count, planes[p + 1, lane0:][None, :] ^ ask[q, p + 1][:, None], 0)
            over |= _add(count, ones, 0)
            if p % 12 == 9 or p + 3 >= width:
                over |= _exceeds(count, radius)
                live = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
                if not live.all():
                    q, over, count = q[live], over[live], [x[live] for x in count]
                    if not len(q):
                        break
        for k, i in enumerate(q.tolist()):
            j = np.flatnonzero(np.unpackbits(~over[k].view(np.uint8), bitorder="little")) + 64 * lane0
            if len(j):
                yield i, j


def _add(count: list[np.ndarray], x: np.ndarray, at: int) -> np.ndarray:
    """Add a bit of weight 2^at to every lane's counter; the lanes that overflow."""
    for k in range(at, len(count)):
        carry = count[k] & x
        count[k] = count[k] ^ x
        x = carry
    return x


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def forest(words: np.ndarray, radius: int) -> np.ndarray:
    """For each row of fingerprints the least row of its group within this set."""
    n = len(words)
    label = np.arange(n)
    if n < 2:
        return label
    for i, near in close_pairs(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), radius):
        met = np.unique(np.append(label[near], label[i]))
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    return label


# ---- buckets


@dataclass(frozen=True)
class Blocks:
    """radius + 1 blocks of bits, again by the remaining bits where a bucket is too large: exact."""

    bits: int
    radius: int
    levels: int = 3

    def tables(self, used: tuple[int, ...]) -> list[np.ndarray]:
        rest = np.arange(self.bits)
        for t in used:
            rest = np.setdiff1d(rest, np.array_split(rest, self.radius + 1)[t])
        return np.array_split(rest, self.radius + 1) if len(rest) > self.radius else []


def _keyed(rows: DataFrame, scheme, level: int) -> DataFrame:
    """A row for each table of the next level; the key hashes the path (a collision only adds comparisons)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, used, keys = (batch.column(c).to_pylist() for c in ("fp", "used", "key"))
            for path in sorted(set(map(tuple, used))):
                at = np.array([i for i, u in enumerate(used) if tuple(u) == path])
                words = np.frombuffer(b"".join(fps[i] for i in at), np.uint8).reshape(len(at), -1)
                bits = np.unpackbits(words, axis=1, bitorder="little")
                old = np.array([keys[i] for i in at], np.int64).view(np.uint64)
                for t, which in enumerate(scheme.tables(path)):
                    packed = np.packbits(bits[:, which], axis=1, bitorder="little")
                    wide = np.zeros((len(at), -(-packed.shape[1] // 8) * 8), np.uint8)
                    wide[:, : packed.shape[1]] = packed
                    with np.errstate(over="ignore"):
                        key = old * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t + 1)
                        for w in wide.view(np.uint64).T:
                            key = (key ^ (key >> np.uint64(31)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fps[i] for i in at], pa.binary()), pa.array([[*path, t]] * len(at), pa.list_(pa.int32())), pa.array(key.view(np.int64))], ["fp", "used", "key"]
                    )

    return rows.select("fp", "used", "key").mapInArrow(work, "fp binary, used array<int>, key bigint")


def _forests(rows: DataFrame, radius: int) -> DataFrame:
    """Forest edges (a, b) of every bucket; rows of a bucket come together and in order, bounded in number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []

        def edges(last: bool):
            cut = len(keys) if last else next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), -1) + 1
            left, right, a = [], [], 0
            while a < cut:
                b = a + 1
                while b < cut and keys[b] == keys[a]:
                    b += 1
                group = sorted(set(fps[a:b]))
                if len(group) > 1:
                    words = np.frombuffer(b"".join(group), np.uint64).reshape(len(group), -1)
                    label = forest(words, radius)
                    for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                        left.append(group[i])
                        right.append(group[label[i]])
                a = b
            del keys[:cut], fps[:cut]
            return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

        for batch in batches:
            keys += batch.column("key").to_pylist()
            fps += batch.column("fp").to_pylist()
            yield edges(False)
        yield edges(True)

    return rows.select("key", "fp").mapInArrow(work, "a binary, b binary")


def links(distinct: DataFrame, radius: int, scheme) -> DataFrame:
    """Forest edges (a, b) between distinct fingerprints (column fp) that join all within the radius, as far as the scheme finds them."""
    rows, out = distinct.select("fp", F.array().cast("array<int>").alias("used"), F.lit(0).cast("long").alias("key")), None
    for level in range(scheme.levels):
        rows = stage(_keyed(rows, scheme, level), "keys")
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # Written first: right after a join on the key Spark drops the repartition below as met already, and where adaptive execution
        # then broadcasts the counts, it reads rows by the task that made them, so that a bucket's rows lie in several tasks.
        sized = stage(rows.join(counts, "key"), "sized")
        discard(rows)
        last = level == scheme.levels - 1
        # Large buckets: one more cut, or at last every pair of their sub-blocks.
        wide = sized.where(F.col("n") > BUCKET)
        small = sized.where(F.col("n") <= BUCKET).select("key", "fp")
        if last:
            parts = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
            mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
            dealt = wide.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            small = small.unionByName(dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp"))
        found = _forests(small.repartition("key").sortWithinPartitions("key"), radius)
        out = found if out is None else out.unionByName(found)
        if last or wide.isEmpty():
            break
        rows = wide.select("fp", "used", "key")
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 64, radius: int = 4, scheme=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the document's group) for every document."""
    scheme = scheme or Blocks(bits, radius)
    prints = stage(fingerprints(docs, words, bits, id_col, text_col), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Nodes are 64-bit: the fingerprint itself, or a hash of a longer one.
    node = (lambda c: F.conv(F.hex(F.col(c)), 16, -10).cast("long")) if bits == 64 else (lambda c: F.xxhash64(c))
    edges = links(distinct, radius, scheme).select(node("a").alias("u"), node("b").alias("v"))
    roots = connected_components(edges)
    placed = distinct.withColumn("node", node("fp")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stage(placed.select("fp", "least", "root"), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, radius=4)
    digits = [F.substring(F.hex("fp"), 2 * k + 1, 2) for k in range(7, -1, -1)]
    return out.select("doc_id", F.lower(F.concat(*digits)).alias("fingerprint"), "component_id")
