"""Near-duplicates by SimHash, kept where the exact Jaccard similarity of distinct shingles is LEAST or more; nothing is lost.

1. SimHash: every distinct text has a 64-bit fingerprint of its distinct shingles. Fingerprints within RADIUS bits are
   found bit-sliced in blocks (simhash.links, exact at that radius). Each link, and each text with its fingerprint's
   first one, is a candidate; those whose exact similarity is 4/5 or more are links.
2. Fingerprints of texts as alike as 4/5 may differ in more bits, so the rest is done exactly. Shingles are put in one order for all
   texts: by hash, frequent ones last. Two texts whose similarity is at least 4/5 share one of the first
   n - ceil(4n/5) + 1 of their n shingles: texts of different groups so far that share one of these are candidates. First
   each is compared with one drawn from each of its buckets. Of texts still in different groups, those of like size meet in the
   buckets, if the places of their first shared shingle leave enough shingles behind it for a similarity of 4/5.
3. A candidate is given up if sizes or bitmaps rule it out. A bitmap has the parity of the shingles of each slot, so
   two bitmaps never differ in more bits than the texts in shingles. What is left is compared shingle by shingle.

Texts are told apart by 64 bits of MD5. Null texts and texts without words have one set of their own, and so are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import at, discard, free_name, lower, release, slices, stage, utf8, word_hashes
from revlytics.llm.components import connected_components
from revlytics.llm.simhash import Blocks, links, majorities

WIDTH = 512
#: Bits in which linked fingerprints differ at most.
RADIUS = 4
#: Shingles seen in HOT texts or more of one in SAMPLE come last; the order decides cost only, never results.
SAMPLE, HOT, MOST_HOT = 4, 3, 200_000
MAPS = [f"b{k}" for k in range(WIDTH // 64)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's runs of `words` words (of all words where there are fewer), ascending, and how many each text has.

    A text without words has one mark of its own, 0.
    """
    n = len(offsets) - 1
    own, whose = word_hashes(lower(data), offsets)
    many = np.bincount(whose, minlength=n)
    begin = np.cumsum(many) - many
    windows = np.where(many > 0, np.maximum(1, many - words + 1), 0)
    doc = np.repeat(np.arange(n), windows)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[doc]
    last = (begin + many)[doc]
    h = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            w = np.where(first + k < last, own[np.minimum(first + k, max(0, len(own) - 1))] + np.uint64(1), np.uint64(0)) if len(own) else h
            h = (h ^ (h >> np.uint64(29)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    doc, h = np.concatenate([doc, np.flatnonzero(many == 0)]), np.concatenate([h, np.zeros(int((many == 0).sum()), np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


def parities(h: np.ndarray, whose: np.ndarray, texts: int, width: int = WIDTH) -> np.ndarray:
    """`width` bits a text, as rows of words: whether a slot has an odd number of the text's shingles."""
    slot = (h >> np.uint64(32)).astype(np.int64) % width
    odd = np.bincount(whose * width + slot, minlength=texts * width) & 1
    return np.packbits(odd.reshape(texts, width) > 0, axis=1, bitorder="little").view(np.int64)


def first_of(h: np.ndarray, count: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which similar texts share one, and how many each text has; `rank` is the place of each of `hot` (ascending) among the frequent ones."""
    least = count - -(-4 * count // 5) + 1
    place = np.full(len(h), -1)
    if len(hot):
        mine = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        place = np.where(hot[mine] == h, rank[mine], -1)
    whose = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, place, whose))
    number = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    return h[order[number < np.repeat(least, count)]], least


def _sets(texts: DataFrame, words: int, made, schema: str) -> DataFrame:
    """made(nodes, hashes, counts) -> arrays, for each slice of texts (node, text); each text once a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                h, count = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                cols = made(batch.column(0)[i:j], h, count)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        release()

    return texts.select("node", "text").mapInArrow(work, schema)


def _lists(h: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(h.view(np.int64)))


def _summary(nodes: pa.Array, h: np.ndarray, count: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> dict:
    """fp, sizes, bitmaps and first shingles; `wide` is a longer bitmap of texts with more shingles than the short one has slots."""
    n = len(count)
    maps = parities(h, np.repeat(np.arange(n), count), n)
    ends = np.cumsum(count)
    wide = [parities(h[b - c : b], np.zeros(c, np.int64), 1, 1 << int(c - 1).bit_length())[0] if c > WIDTH else np.zeros(0, np.int64) for b, c in zip(ends.tolist(), count.tolist())]
    sizes = np.array([len(w) for w in wide])
    return {
        "node": nodes, "fp": pa.array([r.tobytes() for r in majorities(h, count)], pa.binary()), "wide": _lists(np.concatenate([np.zeros(0, np.int64), *wide]), sizes),
        "n": pa.array(count, pa.int32()), "first": _lists(*first_of(h, count, hot, rank)),
    } | {b: pa.array(np.ascontiguousarray(maps[:, k])) for k, b in enumerate(MAPS)}


def _possible(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs (u, v structs) that sizes and bitmaps don't rule out: first the short bitmaps, then those as long as the text."""
    n, m = F.col("u.n"), F.col("v.n")
    apart = sum((F.bit_count(F.col(f"u.{b}").bitwiseXOR(F.col(f"v.{b}"))) for b in MAPS), F.lit(0))
    near = pairs.where((5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m))
    near = near.select(F.col("u.node").alias("u"), F.col("v.node").alias("v"), (n + m).alias("both")).distinct()
    near = near.join(wide.select(F.col("node").alias("u"), F.col("wide").alias("x")), "u", "left").join(wide.select(F.col("node").alias("v"), F.col("wide").alias("y")), "v", "left")
    x, y = _folded(F.col("x"), F.col("y")), _folded(F.col("y"), F.col("x"))
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return near.where(F.isnull("x") | F.isnull("y") | (9 * apart <= F.col("both"))).select("u", "v")


def _rest(rows: DataFrame) -> DataFrame:
    """Pairs (u, v structs) of different groups that share a shingle h which can be the first that they share; few texts of large groups are still by themselves here.

    u is the smaller text. With all shingles before h unshared, at most n - place of either text are shared, and 4/9 of both texts'
    shingles must be. Sizes in a ratio of 5/4 or less are in one band of ratio 1.26, or in neighbouring ones.
    """
    band = F.floor(F.log(F.col("x.n").cast("double")) / F.log(F.lit(1.26))).cast("int")
    small = rows.where("9 * place <= x.n").select("h", band.alias("band"), F.col("root").alias("r"), (F.col("x.n") - F.col("place")).alias("i"), F.col("x").alias("u"))
    large = rows.select("h", F.explode(F.array(band, band - 1)).alias("band"), F.col("root").alias("s"), (F.col("x.n") - F.col("place")).alias("j"), F.col("x").alias("v"))
    ordered = "(u.n < v.n or u.n = v.n and u.node < v.node)"
    return small.join(large, ["h", "band"]).where(f"r <> s and {ordered} and 9 * least(i, j) >= 4 * (u.n + v.n)").select("u", "v")


def _folded(x: Column, y: Column) -> Column:
    """A bitmap x at the width of y, where that is half of its own."""
    k = F.size(y)
    return F.when(F.size(x) > k, F.zip_with(F.slice(x, F.lit(1), k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q))).otherwise(x)


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs whose texts are similar, by their whole sets."""
    pairs = stage(pairs, "pairs")
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    kept = texts.join(asked, "node", "left_semi")
    sets = stage(_sets(kept, words, lambda nodes, h, count: {"node": nodes, "h": _lists(h, count)}, "node bigint, h array<bigint>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("h").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("h").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    out = stage(both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("u", "v"), "links")
    discard(pairs, sets)
    return out


def similar_groups(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (64 bits of the text's MD5), root (the least node of the group) and component_id (its least doc_id) for every document."""
    node = text_node(at(text_col)).alias("node")
    texts = docs.select(node, at(text_col).cast("string").alias("text"))
    ids = stage(docs.select(at(id_col).alias("doc_id"), node), "ids")

    some = _sets(texts.where(F.pmod(F.xxhash64("node"), SAMPLE) == 0), words, lambda nodes, h, count: {"h": pa.array(h.view(np.int64))}, "h bigint")
    often = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    often = often.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow()  # at most MOST_HOT numbers
    hot = often.column("h").to_numpy()[::-1].copy().view(np.uint64)
    rank = np.argsort(hot).astype(np.int32)
    hot = hot[rank]

    schema = "node bigint, fp binary, wide array<bigint>, n int, first array<bigint>, " + ", ".join(f"{b} bigint" for b in MAPS)
    every = stage(_sets(texts, words, lambda nodes, h, count: _summary(nodes, h, count, hot, rank), schema), "summaries")
    once = stage(every.select("node", "fp", "n", *MAPS).distinct(), "nodes")
    wide = every.where(F.size("wide") > 0).select("node", "wide").dropDuplicates(["node"])
    whole = lambda name: F.struct("node", "n", *MAPS).alias(name)

    # 1. SimHash.
    heads = stage(once.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    edges = links(heads.select("fp"), RADIUS, Blocks(64, RADIUS))
    edges = edges.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    near = once.join(heads, "fp").where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y")).unionByName(edges.select("x", "y"))
    u, v = once.select(F.col("node").alias("x"), whole("u")), once.select(F.col("node").alias("y"), whole("v"))
    found = _verified(_possible(near.join(u, "x").join(v, "y"), wide), texts, words)
    roots = stage(connected_components(found), "roots")

    # 2. The rest: shingles that one text alone has give no candidates.
    tokens = every.select("node", F.posexplode("first").alias("place", "h"))
    several = tokens.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("h")
    met = stage(tokens.join(several, "h").distinct(), "met")
    stars = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    # Each text with one drawn for each of its shingles: in a large group every text meets many others, with a row a shingle.
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    drawn = placed.groupBy("h").agg(F.min_by(F.struct("node", "root"), F.xxhash64("h", "node")).alias("p"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    asked = placed.join(drawn.select("h", "p"), "h").where("root <> p.root").select(F.greatest("node", "p.node").alias("x"), F.least("node", "p.node").alias("y")).distinct()
    found = _verified(_possible(asked.join(u, "x").join(v, "y"), wide), texts, words)
    roots = stage(connected_components(stars(roots).unionByName(found)), "roots")

    placed = stage(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    open_ = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    rows = stage(placed.join(open_, "h").join(once, "node").select("h", "place", "root", whole("x")), "open")
    rest = _verified(_possible(_rest(rows), wide), texts, words)

    roots = connected_components(stars(roots).unionByName(rest))
    placed = stage(ids.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "rooted")
    discard(every, once, heads, met, rows)
    # Written first, so that the join has plain exchanges, which adaptive execution splits where one group holds many rows.
    least = stage(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "root").select("doc_id", "node", "root", "component_id")


def text_node(text: Column) -> Column:
    """64 bits of the MD5 of a text; null is empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def one_of_each(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns of docs: the row of the least id (rows without one come last), then of the least node.

    Rows are dropped, not ids: another text under a dropped row's id stays. Of rows alike in id and text any one stays.
    """
    groups = stage(similar_groups(docs, words, id_col, text_col), "groups")
    cells = stage(groups.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n")), "cells")
    best = stage(groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node")).alias("best")), "best")
    judged = stage(cells.join(best, "root").select("doc_id", "node", "n", (F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node") == F.col("best")).alias("stays")), "judged")
    mark = F.struct(text_node(at(text_col)).alias("node"), at(id_col).alias("doc_id"))
    cell = F.struct("node", "doc_id").alias("mark")
    key = free_name(docs, "mark")
    marked = docs.withColumn(key, mark)
    gone = judged.where("not stays or n > 1").select(cell.alias(key))
    again = judged.where("stays and n > 1").select(cell.alias(key))
    once = marked.join(gone, key, "left_anti").select(*map(at, docs.columns))
    return once.unionByName(marked.join(again, key, "left_semi").dropDuplicates([key]).select(*map(at, docs.columns)))
