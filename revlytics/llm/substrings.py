"""Suffix-based removal of repeated passages: every byte under a `length`-byte string that a document with a smaller id has too.

Sorting all suffixes of a corpus in numpy is out of reach, so the transforms are built only where strings can repeat:

1. Window starts are grouped into runs by the least hashed `GRAM`-gram of the window (a minimizer): equal
   windows have equal minimizers, at the same place. A run is known by its anchor and by a hash of its
   whole context. Equal runs are collapsed to the document of least id, first within a batch of texts,
   then by anchor over all texts: later documents lose the whole run.
2. Anchors that remain with several contexts, of several documents, are where matches begin or end.
   Their contexts are fetched and grouped by anchor; those that share too few bytes beside it with any other are left out,
   exactly (may_match). The rest are sorted as shards, and the shards' Burrows-Wheeler
   transforms are merged by interleave refinement (`bwt.merge`). Blocks that share `length` bytes are the
   repeated intervals; all but those of least id are marked. Anchors with very many contexts are
   dealt out window by window instead: those that a sample shows (HOT_SAMPLE) already in step 1, where a window takes the place
   of a run and is collapsed like one, so that a passage of any number of documents costs a row a batch; others in step 2.
3. Marks of all kinds meet the texts, and covered bytes are removed.

Hashes only decide what is compared (32 bits of anchor within a bucket) and when two contexts under one
anchor are the same (48 bits more). Rows of different texts with one doc_id are told apart
by 32 bits of a hash of the text and never remove from each other. Null texts count as empty; rows with a null doc_id
keep their text and are no source; repeated rows give equal rows. Columns are carried along whatever their names.
A text longer than a slice is read in pieces; a run cut by a piece's end is one more context of its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from revlytics.llm.bwt import Shard, merge
from revlytics.llm.common import _BASE, at, carried, power_table, release, restored, slices, stage, table, utf8

LENGTH, GRAM = 50, 20
#: Bytes of text of which a batch collapses its runs, of a group's texts, and of texts for each bucket of their runs.
BATCH_BYTES, GROUP_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20, 2 << 20
#: Bytes of a long text that are hashed at a time.
PIECE_BYTES = 1 << 18
#: Bytes of contexts that one task's transforms hold, about.
CONTEXT_BYTES = 1 << 20
#: Contexts under one anchor above which they are dealt out window by window.
HOT = 4_000
#: One text in SAMPLE is looked at for anchors with HOT_SAMPLE contexts or more; at most MOST_HOT of them are dealt out at once.
#: This decides cost only, never results.
SAMPLE, HOT_SAMPLE, MOST_HOT = 16, 32, 100_000
SHARDS = 4

RUN = {"doc": np.int64, "tag": np.uint32, "pos": np.uint32, "num": np.uint32, "anchor": np.uint32, "ctx_a": np.uint32, "ctx_b": np.uint16}
MARK = {"doc": np.int64, "tag": np.uint32, "pos": np.uint32, "num": np.uint32}
#: Contexts that are asked for: bucket of the anchor and whether it is hot.
ASK = MARK | {"anchor": np.uint32, "bucket": np.uint32, "hot": np.uint8}
#: Fields that are packed as differences: entries are sorted by them.
STEPS = ("doc", "tag")
CODEC = pa.Codec("zstd", compression_level=1)


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Hash:
    """Hashes of any byte range of a block."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = power_table(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[end] - self.sum[begin]) * self.down[begin]


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of window starts with one minimizer: row, first start (in its text), how many, 64-bit hashes of anchor and context.

    A run with an anchor of `hot` (ascending) is given window by window, each with an anchor of its own.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return {"row": empty, "pos": empty, "num": empty, "anchor": empty.astype(np.uint64), "ctx": empty.astype(np.uint64)}
    h = _Hash(data)
    at = np.arange(n - gram + 1)
    poly = h.of(at, at + gram)
    v = (_mix(poly, 0xBF58476D1CE4E5B9) >> np.uint64(32)) << np.uint64(32) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: -(width - span)], v[width - span :])
    least = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window start
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[: len(least)]
    valid = np.arange(len(least)) + length <= offsets[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return {"row": empty, "pos": empty, "num": empty, "anchor": empty.astype(np.uint64), "ctx": empty.astype(np.uint64)}
    new = np.ones(len(start), bool)
    new[1:] = (least[start[1:]] != least[start[:-1]]) | (row[start[1:]] != row[start[:-1]])
    first = start[new]
    num = np.diff(np.append(np.flatnonzero(new), len(start)))
    anchor = _mix(poly[least[first]], 0xA0761D6478BD642F)
    del v, least, valid, start, new, poly
    if hot is not None and len(hot):
        deal = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        many = np.where(deal, num, 1)
        which = np.repeat(np.arange(len(num)), many)
        first = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        num, anchor, deal = np.where(deal, 1, num)[which], anchor[which], deal[which]
    with np.errstate(over="ignore"):
        body = h.of(first, first + num + length - 1)
        ctx = _mix(body + num.astype(np.uint64) * np.uint64(_BASE), 0xD6E8FEB86659FD93)
        if hot is not None and len(hot):
            anchor = np.where(deal, _mix(anchor ^ body, 0xE7037ED1A0B428DB), anchor)
    return {"row": row[first], "pos": first - offsets[row[first]], "num": num, "anchor": anchor, "ctx": ctx}


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, position, bytes, offsets) of a batch's slices; a long text in pieces that overlap by length - 1."""
    for i, j in slices(offsets, PIECE_BYTES):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= 2 * PIECE_BYTES:
            yield i, j, 0, data[a:b], offsets[i : j + 1] - a
            continue
        for x in range(0, b - a - length + 1, PIECE_BYTES):
            part = data[a + x : min(b, a + x + PIECE_BYTES + length - 1)]
            yield i, j, x, part, np.array([0, len(part)])


# ---- packed rows: a key, a kind, how many entries, and their fields


PACKED = "key int, kind int, n int, fields binary"
PACKED_ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("fields", pa.binary())])


def _planes(schema: dict, n: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bytes of an entry; for rows of n entries, where each entry's first byte lies and how far its next one is."""
    width = sum(np.dtype(t).itemsize for t in schema.values())
    return width, np.repeat((np.cumsum(n) - n) * (width - 1), n) + np.arange(int(n.sum())), np.repeat(n, n)


def _packed(schema: dict, kind: int, key: np.ndarray, fields: dict[str, np.ndarray]) -> list[dict]:
    """A row for each key. First bytes of all its entries' values lie together, then second ones, and so on, so that what varies little takes little room."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    width, place, step = _planes(schema, n)
    raw = np.empty(len(key) * width, np.uint8)
    for c, t in schema.items():
        v = fields[c].astype(t, copy=False)[order]
        if c in STEPS:
            whole, v = v, v.copy()
            v[1:] -= whole[:-1]
            v[first] = whole[first]
        for plane in v.view(np.uint8).reshape(len(key), -1).T:
            raw[place] = plane
            place += step
    ends = ((first + n) * width).tolist()
    return [{"key": k, "kind": kind, "n": m, "fields": CODEC.compress(raw[end - m * width : end], asbytes=True)} for k, m, end in zip(key[first].tolist(), n.tolist(), ends)]


def _unpacked(rows: pa.Table, schema: dict) -> dict[str, np.ndarray]:
    n = rows.column("n").to_numpy().astype(np.int64)
    width, place, step = _planes(schema, n)
    raw = np.frombuffer(b"".join(CODEC.decompress(x, m * width, asbytes=True) for x, m in zip(rows.column("fields").to_pylist(), n.tolist())), np.uint8)
    first, out = np.cumsum(n) - n, {}
    for c, t in schema.items():
        v = np.empty((len(place), np.dtype(t).itemsize), np.uint8)
        for k in range(v.shape[1]):
            v[:, k] = raw[place]
            place += step
        v = v.view(t).reshape(-1)
        if c in STEPS:
            total = np.cumsum(v, dtype=t)
            v = total - np.repeat(total[first] - v[first], n)
        out[c] = v
    return out


def _sorted(fields: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((fields["pos"], fields["tag"], fields["doc"]))
    return {c: v[order] for c, v in fields.items()}


def _by(key: np.ndarray, fields: dict[str, np.ndarray]) -> Iterator[tuple[int, dict]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.diff(key)) + 1
    for part in np.split(np.arange(len(key)), edges) if len(key) else []:
        yield int(key[part[0]]), {c: v[order[part]] for c, v in fields.items()}


def _group_of(doc: np.ndarray, tag: np.ndarray, groups: int) -> np.ndarray:
    x = doc.view(np.uint64)
    return ((x ^ (x >> np.uint64(17)) ^ tag.astype(np.uint64)) & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64) % groups


def _with_group(docs: DataFrame, groups: int) -> DataFrame:
    """docs (doc, text) with _doc, _tag, _group; as _group_of has it."""
    doc, tag = F.col("doc").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))
    mixed = doc.bitwiseXOR(F.shiftrightunsigned(doc, 17)).bitwiseXOR(tag).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    group = F.when(doc.isNull(), F.pmod(F.xxhash64("text"), F.lit(groups))).otherwise(F.pmod(mixed, F.lit(groups)))
    return docs.withColumns({"_doc": doc, "_tag": tag, "_group": group.cast("int")})


def _hot_anchors(source: DataFrame, length: int) -> np.ndarray:
    """Anchors with very many contexts, by a sample of the texts; at most MOST_HOT, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            held = [runs_of(part, at_, length) for _, _, _, part, at_ in _pieces(data, offsets, length)]
            if held:
                both = np.unique(np.stack([np.concatenate([h[c] for h in held]) for c in ("anchor", "ctx")], axis=1), axis=0)
                anchor, n = np.unique(both[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["anchor", "n"])
        release()

    some = source.where((F.pmod(F.xxhash64("_doc", "_tag"), F.lit(SAMPLE)) == 0) & F.col("_doc").isNotNull()).select("text").mapInArrow(work, "anchor bigint, n bigint")
    often = some.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SAMPLE).orderBy(F.desc("n"), "anchor").limit(MOST_HOT)
    return np.sort(np.array([r["anchor"] for r in often.collect()], np.int64).view(np.uint64))


def _local_runs(source: DataFrame, buckets: int, groups: int, length: int) -> DataFrame:
    """Runs by anchor bucket (kind 0), each once a batch for the least doc of the batch; marks of the others (kind 1)."""
    hot = _hot_anchors(source, length)

    def emit(held: list[dict]) -> pa.RecordBatch:
        f = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        f = _sorted(f)
        order = np.lexsort((f["doc"], f["ctx"], f["anchor"]))
        ctx, anchor, doc = f["ctx"][order], f["anchor"][order], f["doc"][order]
        same = np.zeros(len(order), bool)
        same[1:] = (ctx[1:] == ctx[:-1]) & (anchor[1:] == anchor[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = np.zeros(len(order), bool)
        later[order] = doc > doc[head]
        gone = {c: f[c][later] for c in MARK}
        rows = _packed(MARK, 1, _group_of(gone["doc"], gone["tag"], groups), gone)
        keep = {c: v[~later] for c, v in f.items()}
        bucket = ((keep["anchor"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        keep |= {"ctx_a": keep["ctx"] >> np.uint64(32), "ctx_b": keep["ctx"] & np.uint64(0xFFFF), "anchor": keep["anchor"] & np.uint64(0xFFFFFFFF)}
        del f, keep["ctx"], order, ctx, anchor, doc, same, head
        return pa.RecordBatch.from_pylist(rows + _packed(RUN, 0, bucket, keep), PACKED_ARROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc, tag = batch.column("_doc").to_numpy(), batch.column("_tag").to_numpy()
            for i, j, x, part, at_ in _pieces(data, offsets, length):
                r = runs_of(part, at_, length, hot=hot)
                if len(r["row"]):
                    held.append({"doc": doc[i:j][r["row"]], "tag": tag[i:j][r["row"]].astype(np.uint32), "pos": (r["pos"] + x).astype(np.uint32), "num": r["num"].astype(np.uint32), "anchor": r["anchor"], "ctx": r["ctx"]})
                size += len(part)
                if size >= BATCH_BYTES and held:
                    out, held, size = emit(held), [], 0
                    yield out
                    del out
        if held:
            yield emit(held)
        release()

    return source.where("_doc is not null").select("_doc", "_tag", "text").mapInArrow(work, PACKED)


def _decide(runs: DataFrame, groups: int) -> DataFrame:
    """By anchor bucket: marks of runs that a smaller doc has (kind 1), and contexts asked for (kind 2), both by group of docs."""

    def work(rows: pa.Table) -> pa.Table:
        key, out = rows.column("key")[0].as_py(), []
        done = rows.filter(pa.compute.equal(rows.column("kind"), 1)).select(PACKED_ARROW.names).cast(PACKED_ARROW)
        f = _unpacked(rows.filter(pa.compute.equal(rows.column("kind"), 0)), RUN)
        if len(f["doc"]):
            ctx = f.pop("ctx_a").astype(np.uint64) << np.uint64(16) | f.pop("ctx_b").astype(np.uint64)
            order = np.lexsort((f["doc"], ctx, f["anchor"]))
            f, ctx = {c: v[order] for c, v in f.items()}, ctx[order]
            n = len(order)
            new_anchor = np.ones(n, bool)
            new_anchor[1:] = f["anchor"][1:] != f["anchor"][:-1]
            new_ctx = new_anchor.copy()
            new_ctx[1:] |= ctx[1:] != ctx[:-1]
            head = np.maximum.accumulate(np.where(new_ctx, np.arange(n), 0))
            later = f["doc"] > f["doc"][head]
            gone = _sorted({c: f[c][later] for c in MARK})
            out += _packed(MARK, 1, _group_of(gone["doc"], gone["tag"], groups), gone)
            which = np.cumsum(new_anchor) - 1
            contexts = np.bincount(which, weights=new_ctx)
            first = np.flatnonzero(new_anchor)
            low, high = np.minimum.reduceat(f["doc"], first), np.maximum.reduceat(f["doc"], first)
            ask = ((contexts > 1) & (low < high))[which] & ~later
            more = {c: f[c][ask] for c in (*MARK, "anchor")} | {"hot": (contexts > HOT)[which][ask].astype(np.uint8)}
            more["bucket"] = np.full(int(ask.sum()), key, np.uint32)
            more = _sorted(more)
            out += _packed(ASK, 2, _group_of(more["doc"], more["tag"], groups), more)
            del f, ctx, order, head, later, which, ask, gone, more
        made = pa.concat_tables([done, pa.Table.from_pylist(out, PACKED_ARROW)])
        del out, done, rows
        release()
        return made

    # Marks pass through any bucket's task.
    return runs.groupBy("key").applyInArrow(work, PACKED)


def _rows_of(texts: pa.Table, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its (doc, tag), and for each asked (doc, tag) that number (-1: none)."""
    own_doc = np.array([x if x is not None else 0 for x in texts.column("_doc").to_pylist()], np.int64)
    known = np.array(texts.column("_doc").is_valid().to_pylist(), bool)
    own_tag = np.array(texts.column("_tag").to_pylist(), np.int64)
    pairs = np.stack([own_doc, np.where(known, own_tag, 1 << 40)], axis=1)
    unique, mine = np.unique(pairs, axis=0, return_inverse=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
    asked = np.stack([doc, tag.astype(np.int64)], axis=1) if len(doc) else np.zeros((0, 2), np.int64)
    both, code = np.unique(np.concatenate([unique, asked]), axis=0, return_inverse=True)
    code = code.reshape(-1)
    number = np.full(len(both), -1)
    number[code[: len(unique)]] = np.arange(len(unique))
    return mine.reshape(-1), number[code[len(unique) :]]


def _contexts(source: DataFrame, asks: DataFrame, tasks: int, length: int) -> DataFrame:
    """The asked contexts' bytes, by anchor (a hot anchor's by window)."""
    schema = PACKED_ARROW.append(pa.field("body", pa.binary()))

    def work(texts: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        f = _unpacked(rows, ASK)
        if len(f["doc"]) and texts.num_rows:
            mine, row = _rows_of(texts, f["doc"], f["tag"])
            data, offsets = utf8(texts.column("text").cast(pa.large_string()))
            first = np.zeros(int(mine.max()) + 1, np.int64)
            first[mine[::-1]] = np.arange(len(mine))[::-1]
            ok = row >= 0
            f, row = {c: v[ok] for c, v in f.items()}, row[ok]
            begin = offsets[first[row]] + f["pos"]
            key = f["anchor"].astype(np.int64) * 0x9E3779B1 + f["bucket"].astype(np.int64) * 0x85EBCA77
            num, pos = f["num"].astype(np.int64), f["pos"].astype(np.int64)
            hot = f["hot"] > 0
            if hot.any():
                many = np.where(hot, num, 1)
                src = np.repeat(np.arange(len(num)), many)
                step = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
                begin, pos, num, key = begin[src] + step, pos[src] + step, np.where(hot[src], 1, num[src]), key[src]
                f = {c: v[src] for c, v in f.items()}
                for i in np.flatnonzero(hot[src]).tolist():
                    key[i] = np.uint64(xxhash.xxh64_intdigest(data[begin[i] : begin[i] + length].tobytes())).astype(np.int64)
            size = num + length - 1
            target = (_mix(key.view(np.uint64), 0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % tasks
            for t, part in _by(target, {"doc": f["doc"], "tag": f["tag"], "pos": pos, "num": num, "size": size, "begin": begin}):
                body = b"".join(data[b : b + s].tobytes() for b, s in zip(part["begin"].tolist(), part["size"].tolist()))
                out += [r | {"body": body} for r in _packed(MARK, 0, np.full(len(part["doc"]), t), part)]
        return pa.Table.from_pylist(out, schema)

    left = source.select("_doc", "_tag", "text", "_group").groupBy("_group")
    return left.cogroup(asks.groupBy("key")).applyInArrow(work, PACKED + ", body binary")


def may_match(body: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which contexts can share a window with one of another doc: those that share the anchor and half of a window's other bytes before it or after it.

    A shared window has its anchor at one place in both, and at least that half of its other bytes on one side. So no match is lost.
    """
    h, half, keep = _Hash(body), (length - gram + 1) // 2, np.zeros(len(doc), bool)
    low, high = offsets[:-1], offsets[1:]
    at = low[:, None] + np.arange(length - gram + 1)
    anchor = low + np.argmin(_mix(h.of(at, at + gram), 0xBF58476D1CE4E5B9) >> np.uint64(32), axis=1)  # of the first window; runs_of has the same
    for begin, end in ((anchor - half, anchor + gram), (anchor, anchor + gram + half)):
        i = np.flatnonzero((begin >= low) & (end <= high))
        if not len(i):
            continue
        key = h.of(begin[i], end[i])
        order = np.argsort(key)
        i, key = i[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(doc[i], first) < np.maximum.reduceat(doc[i], first)
        keep[i] |= np.repeat(several, np.diff(np.append(first, len(i))))
    return keep


def repeated_starts(parts: list[tuple[np.ndarray, np.ndarray]], doc: list[np.ndarray], num: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of strings, their docs and how many starts of each count: shard, string and start of windows that a smaller doc has too."""
    z, string, at, block = merge([Shard(data, offsets) for data, offsets in parts], length)
    base = np.cumsum([0, *(len(d) for d in doc)])
    which = base[z] + string
    whose, many = np.concatenate(doc)[which], np.concatenate(num)[which]
    ok = at < many
    z, string, at, block, whose = z[ok], string[ok], at[ok], block[ok], whose[ok]
    if not len(block):
        return z, string, at
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.repeat(np.minimum.reduceat(whose, first), np.diff(np.append(first, len(block))))
    later = whose > least
    return z[later], string[later], at[later]


def _resolve(contexts: DataFrame, groups: int, length: int) -> DataFrame:
    """Marks of repeated windows from the merged transforms of each group of anchors."""

    def work(rows: pa.Table) -> pa.Table:
        f, out = _unpacked(rows, MARK), []
        body = np.frombuffer(b"".join(rows.column("body").to_pylist()), np.uint8)
        size = f["num"].astype(np.int64) + length - 1
        keep = may_match(body, np.concatenate([[0], np.cumsum(size)]), f["doc"], length)
        body, size, f = body[np.repeat(keep, size)], size[keep], {c: v[keep] for c, v in f.items()}
        n = len(size)
        if not n:
            return PACKED_ARROW.empty_table()
        offsets = np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.linspace(0, n, min(SHARDS, n) + 1).astype(int))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        parts = [(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in spans]
        z, string, at = repeated_starts(parts, [f["doc"][a:b] for a, b in spans], [f["num"][a:b] for a, b in spans], length)
        i = np.array([a for a, _ in spans])[z] + string
        order = np.lexsort((at, i))
        i, at = i[order], at[order]
        if len(i):  # neighbouring starts become one mark
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            num = np.diff(np.append(first, len(i)))
            i, at = i[first], at[first]
            gone = _sorted({"doc": f["doc"][i], "tag": f["tag"][i], "pos": f["pos"][i] + at, "num": num})
            out = _packed(MARK, 1, _group_of(gone["doc"], gone["tag"], groups), gone)
        return pa.Table.from_pylist(out, PACKED_ARROW)

    return contexts.groupBy("key").applyInArrow(work, PACKED)


def covered(offsets: np.ndarray, row: np.ndarray, pos: np.ndarray, num: np.ndarray, length: int) -> np.ndarray:
    """A flag for each byte of texts that lies under a marked window."""
    step = np.zeros(int(offsets[-1]) + 1, np.int32)
    begin = offsets[row] + pos
    np.add.at(step, begin, 1)
    np.add.at(step, begin + num + length - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(source: DataFrame, marks: DataFrame, length: int, out_schema, finish) -> DataFrame:
    """Texts and marks by group of docs; finish(texts, bytes, offsets, removed flags) gives the rows."""

    def work(texts: pa.Table, rows: pa.Table) -> pa.Table:
        f = _unpacked(rows, MARK)
        texts = texts.combine_chunks()
        data, offsets = utf8(texts.column("text").cast(pa.large_string()))
        removed = np.zeros(len(data), bool)
        if len(f["doc"]) and texts.num_rows:
            mine, row = _rows_of(texts, f["doc"], f["tag"])
            ok = row >= 0
            pos, num, row = f["pos"][ok].astype(np.int64), f["num"][ok].astype(np.int64), row[ok]
            order = np.argsort(row, kind="stable")
            pos, num, row = pos[order], num[order], row[order]
            begin, end = np.searchsorted(row, mine, "left"), np.searchsorted(row, mine, "right")
            many = end - begin  # marks of each text; repeated rows share theirs
            text = np.repeat(np.arange(len(mine)), many)
            at = np.repeat(begin, many) + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            removed = covered(offsets, text, pos[at], num[at], length)
        return finish(texts, data, offsets, removed)

    return source.groupBy("_group").cogroup(marks.groupBy("key")).applyInArrow(work, out_schema)


def marks_of(source: DataFrame, total: int, groups: int, length: int) -> DataFrame:
    """Packed marks of all windows to remove, by group of docs."""
    buckets = max(8, total // BUCKET_BYTES)
    decided = stage(_decide(_local_runs(source, buckets, groups, length), groups), "decided")
    asks = decided.where("kind = 2")
    asked = asks.agg(F.sum("n")).first()[0] or 0
    tasks = max(8, asked * (length + 18) // CONTEXT_BYTES)
    found = stage(_resolve(_contexts(source, asks, int(tasks), length), groups, length), "found")
    return decided.where("kind = 1").unionByName(found)


def _prepared(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs (doc, text, ...) ready to be grouped; bytes of text; groups."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = max(8, total // GROUP_BYTES)
    return _with_group(docs, groups), total, groups


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    named = docs.select(at(id_col).alias("doc"), F.coalesce(at(text_col).cast("string"), F.lit("")).alias("text"))
    source, total, groups = _prepared(named)
    kind = named.schema["doc"].dataType
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(texts, data, offsets, removed):
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        edge[first] = removed[first]
        total = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[offsets[1:]] - c[offsets[:-1]]
        sha = [hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.Table.from_arrays([texts.column("doc"), pa.array(np.diff(offsets)), pa.array(total(removed)), pa.array(total(edge)), pa.array(sha, pa.string())], names)

    out = f"doc_id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _cut(source, marks_of(source, total, groups, length), length, out, finish)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The same rows and columns without repeated passages; a null text comes back empty; a character cut in part goes whole; n_chars, where present, follows."""
    named = docs.select(carried(docs, text_col).alias("row"), at(id_col).alias("doc"), F.coalesce(at(text_col).cast("string"), F.lit("")).alias("text"))
    source, total, groups = _prepared(named)

    def finish(texts, data, offsets, removed):
        kept = [data[a:b][~removed[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.Table.from_arrays([texts.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    schema = StructType([named.schema["row"], StructField("text", StringType())])
    out = _cut(source, marks_of(source, total, groups, length), length, schema, finish)
    out = out.select(*restored(docs, text_col, F.col("text").cast(docs.schema[text_col].dataType)))
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(at(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
