"""Media columns in a content-defined chunk store.

A payload is stored as an 8-bit PCM WAV file. The file is cut where a rolling gear hash says so, and
stored as an ordered list of chunk digests beside the chunks that it owns:

1. `chunk_lists` reads the texts and writes digests only: for each row its medium's key, for one row a slice the medium's chunk list.
2. Chunk digests are deduplicated by Spark joins (`plan_store`): a digest of several media is owned by the one of least key; the
   others borrow it.
3. `write_store` reads the texts again and writes each medium once, with the bodies of the chunks that it owns: the bytes of every digest are stored once.
4. `read_back` rebuilds each medium from its ordered list, own chunks from its row, borrowed ones from their owners by a join, and
   verifies every chunk and the whole file against their digests.

Most media share no chunk and occur once; they are written and read without any exchange. A Bloom filter of fixed size says which
surely do; the rest (its false positives too) are exchanged by key, one row a batch and medium, so the filter's size affects cost only:
beyond some ten million media that share, every text is exchanged once. Joins are left to the planner, which
broadcasts a side only below its own size threshold.

A payload is the text's UTF-8 with zero bytes up to a positive multiple of 64. Null texts count as empty;
equal texts are one medium; repeated rows each get its values; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import at, discard, release, slices, stage, table, utf8

RATE = 8000
#: Chunk sizes: least, usual (a power of two), most.
LEAST, USUAL, MOST = 256, 1024, 8192
#: Bits of a Bloom filter, whatever the input: 8 MB.
BLOOM_BITS = 1 << 26
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def wav(payload: bytes) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload


def wav_samples(stored: bytes) -> bytes:
    """The samples of a stored file; raises where it isn't what `wav` writes."""
    if stored[:4] != b"RIFF" or stored[8:16] != b"WAVEfmt " or stored[36:40] != b"data":
        raise ValueError("not a WAV file of 8-bit samples")
    (n,) = struct.unpack("<I", stored[40:44])
    if len(stored) != 44 + n:
        raise ValueError("a WAV file of another length than it says")
    return stored[44:]


def cut_marks(data: np.ndarray) -> np.ndarray:
    """Places whose gear hash over the 32 bytes before them is zero in its top bits."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return np.flatnonzero(h >> np.uint32(32 - USUAL.bit_length() + 1) == 0) + 1


def chunks(stored: bytes) -> list[bytes]:
    marks, out, at = cut_marks(np.frombuffer(stored, np.uint8)), [], 0
    while at < len(stored):
        i = int(np.searchsorted(marks, at + LEAST))
        end = min(int(marks[i]) if i < len(marks) else len(stored), at + MOST, len(stored))
        out.append(stored[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = x.astype(np.float64) - 128
    turns = int((np.diff(np.signbit(level)) != 0).sum())
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"samples={len(x)};mean={level.mean():.6f};rms={np.sqrt((level**2).mean()):.6f};turns={turns};peak={int(x.max())};entropy={entropy:.6f}"


LIST = "media_key binary, n_bytes bigint, media_sha256 binary, digests array<binary>"
STORE = "media_key binary, media_sha256 binary, digests array<binary>, bodies array<binary>, borrows boolean"
_BYTES = pa.list_(pa.binary())


def medium(raw: bytes) -> tuple[bytes, bytes, bytes]:
    """Stored form, its SHA-256, and the medium's key (padding hides the length, so the key has it)."""
    stored = wav(raw + bytes(-len(raw) % 64 if raw else 64))
    sha = hashlib.sha256(stored).digest()
    return stored, sha, hashlib.blake2b(len(raw).to_bytes(8, "little") + sha, digest_size=16).digest()


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its medium; digests only in the first row of a medium within a slice."""
    source = docs.select(at(id_col).alias("doc_id"), at(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                columns, seen = [[] for _ in range(4)], set()
                for n in range(i, j):
                    size = int(offsets[n + 1] - offsets[n])
                    stored, sha, key = medium(data[offsets[n] : offsets[n + 1]].tobytes())
                    parts = None if key in seen else [digest(p) for p in chunks(stored)]
                    seen.add(key)
                    for c, v in zip(columns, (key, size, sha, parts)):
                        c.append(v)
                kinds = (pa.binary(), pa.int64(), pa.binary(), _BYTES)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "media_key", "n_bytes", "media_sha256", "digests"])
        release()

    return source.mapInArrow(work, f"doc_id {kind}, {LIST}")


def plan_store(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media that share chunks (media_key, lends and borrows: arrays of digests), and the keys of all that can't be written where they are read."""
    listed = lists.where("digests is not null").select("media_key", F.explode("digests").alias("digest"))
    shared = listed.groupBy("digest").agg(F.min("media_key").alias("owner"), F.max("media_key").alias("last")).where("owner <> last").select("digest", "owner")
    roles = listed.join(shared, "digest").distinct()
    pick = lambda own: F.collect_list(F.when((F.col("media_key") == F.col("owner")) == F.lit(own), F.col("digest")))
    plan = stage(roles.groupBy("media_key").agg(pick(True).alias("lends"), pick(False).alias("borrows")), "plan")  # at most a medium's chunks
    # Every medium of several rows counts, however batches were cut: only what occurs once may be written where it is read.
    many = lists.groupBy("media_key").agg(F.count("*").alias("n")).where("n > 1").select("media_key")
    return plan, plan.select("media_key").unionByName(many)


def _places(key: Column) -> list[Column]:
    """Two places of a key in the filter: its first and second 32 bits."""
    return [F.pmod(F.conv(F.hex(F.substring(key, i, 4)), 16, 10).cast("long"), F.lit(BLOOM_BITS)) for i in (1, 5)]


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter's words, BLOOM_BITS bits whatever the input, over media_key."""
    places = keys.select(F.explode(F.array(*_places(F.col("media_key")))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    got = words.toArrow()  # at most BLOOM_BITS / 64 rows
    out[got.column("word").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint64)


def _passes(words: np.ndarray, key: bytes) -> bool:
    a, b = (int.from_bytes(key[i : i + 4], "big") % BLOOM_BITS for i in (0, 4))
    return bool(int(words[a >> 6]) >> (a & 63) & int(words[b >> 6]) >> (b & 63) & 1)


def _stored_rows(rows: Iterator[tuple[bytes, list, list]]) -> pa.RecordBatch:
    """Rows of the store for (text, lends, borrows): a body only at a digest's first place, and only if it is owned."""
    columns = [[] for _ in range(6)]
    for raw, lends, borrows in rows:
        stored, sha, key = medium(raw)
        parts, other = chunks(stored), set(borrows or ())
        names, bodies = [digest(p) for p in parts], []
        for name, part in zip(names, parts):
            bodies.append(None if name in other else part)
            other.add(name)
        for c, v in zip(columns, (key, sha, names, bodies, bool(borrows), lends or None)):
            c.append(v)
    kinds = (pa.binary(), pa.binary(), _BYTES, _BYTES, pa.bool_(), _BYTES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["media_key", "media_sha256", "digests", "bodies", "borrows", "lends"])


def write_store(docs: DataFrame, plan: DataFrame, unsure: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each distinct medium: STORE, and lends (its digests that others borrow)."""
    source = docs.select(at(text_col).cast("string").alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(bloom(unsure))  # BLOOM_BITS bits

    def each(batches: Iterator[pa.RecordBatch], doubtful: bool) -> Iterator[tuple[list, list]]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                keys, raws, seen = [], [], set()
                for n in range(i, j):
                    raw = data[offsets[n] : offsets[n + 1]].tobytes()
                    key = medium(raw)[2]
                    if key not in seen and _passes(words.value, key) == doubtful:
                        keys.append(key)
                        raws.append(raw)
                    seen.add(key)
                yield keys, raws

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in each(batches, False):
            yield _stored_rows((r, None, None) for r in raws)
        release()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raws in each(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["media_key", "body"])
        release()

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("body"))
            for i, j in slices(offsets):
                yield _stored_rows(zip(*(batch.column(c)[i:j].to_pylist() for c in ("body", "lends", "borrows"))))
        release()

    kinds = STORE + ", lends array<binary>"
    moved = source.mapInArrow(rest, "media_key binary, body binary").dropDuplicates(["media_key"]).join(plan, "media_key", "left").select("body", "lends", "borrows")
    return source.mapInArrow(sure, kinds).unionByName(moved.mapInArrow(planned, kinds))


RESULT = "media_key binary, media_sha256 binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string"
_RESULT_SCHEMA = pa.schema(
    [("media_key", pa.binary()), ("media_sha256", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())]
)


def verified(key: bytes, sha: bytes, digests: list[bytes], bodies: list[bytes | None], brought: list[dict] | None = None) -> dict:
    """A medium put together in order from own and borrowed chunks, each checked against its digest and the whole against the file's."""
    held = {d: b for d, b in zip(digests, bodies, strict=True) if b is not None} | {x["digest"]: x["body"] for x in brought or ()}
    if any(digest(b) != d for d, b in held.items()):
        raise ValueError("a chunk differs from its digest")
    stored = b"".join([held[d] for d in digests])
    if hashlib.sha256(stored).digest() != sha:
        raise ValueError("a medium differs from its digest")
    payload = wav_samples(stored)
    return {"media_key": key, "media_sha256": sha, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(stored), "feature": features(payload)}


def read_back(store: DataFrame) -> DataFrame:
    """A row for each medium of a store, rebuilt from its chunks and verified."""

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                columns = [batch.column(c)[k : k + 64].to_pylist() for c in batch.schema.names]
                yield pa.RecordBatch.from_pylist([verified(*row) for row in zip(*columns)], _RESULT_SCHEMA)
        release()

    own = ["media_key", "media_sha256", "digests", "bodies"]
    lent = store.where("lends is not null").select("lends", F.explode(F.arrays_zip("digests", "bodies")).alias("c"))
    lent = lent.where(F.array_contains("lends", F.col("c.digests")) & F.col("c.bodies").isNotNull()).select(F.col("c.digests").alias("digest"), F.col("c.bodies").alias("body"))
    asked = store.where("borrows").select("media_key", F.explode(F.arrays_zip("digests", "bodies")).alias("c")).where("c.bodies is null").select("media_key", F.col("c.digests").alias("digest")).distinct()
    brought = asked.join(lent, "digest").groupBy("media_key").agg(F.collect_list(F.struct("digest", "body")).alias("brought"))  # at most a medium's chunks
    borrowers = store.where("borrows").select(*own).join(brought, "media_key")
    return store.where("not borrows").select(*own).mapInArrow(rebuilt, RESULT).unionByName(borrowers.mapInArrow(rebuilt, RESULT))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """List, deduplicate, store, read back: a row for each document with its medium's values."""
    lists = stage(chunk_lists(docs, id_col, text_col), "lists")
    plan, unsure = plan_store(lists)
    store = stage(write_store(docs, plan, unsure, text_col), "store")
    media = stage(read_back(store), "media")
    discard(plan, store)
    return lists.select("doc_id", "media_key", "n_bytes").join(media, "media_key").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")


def op5_media_chunks(spark, sf_dir: str) -> DataFrame:
    return store_media(table(spark, sf_dir, "documents"))
