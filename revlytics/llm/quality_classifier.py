"""Supervised subword embeddings for document quality.

Words, character n-grams (4 bytes, across the whole lower-cased text) and, for each window of three
words, whether the text had it before, are hashed into one table of vectors; a document is the mean of its vectors, put through a softmax layer. Vectors and layer
are trained together by stochastic gradient descent in numpy on the driver, over at most `max_rows` labelled
documents and `max_bytes` of their text (in the order of the id's hash), which bounds the driver's work.

With two classes the margin is linear in the mean, so a trained model is folded into one number a
bucket; scoring a text is a hashed gather and a mean, inside Spark tasks, over the whole text.
Null and empty texts have no features and get the score of the bias. Repeated rows give equal rows; all columns are
carried along, whatever their names; without labels the model is the zero model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from revlytics.llm.common import _BASE, at, carried, lower, release, restored, slices, table, utf8, word_hashes

GRAM = 4


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int32)


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of a block, each feature's document, and the number of features a document has."""
    n = len(offsets) - 1
    low = lower(data)
    if not len(low):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(n, np.int64)
    words, of_word = word_hashes(low, offsets)
    wide = low.astype(np.uint32)
    gram = wide[: max(0, len(low) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        gram = gram << np.uint32(8) | wide[k : k + len(gram)]
    whose = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    whole = whose[: len(gram)] == whose[GRAM - 1 :] if len(gram) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        grams = (gram[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE) ^ np.uint64(0x5555)
    seen, of = _seen_before(words, of_word)
    ids = np.concatenate([_bucket(words, bits), _bucket(grams, bits), _bucket(seen.astype(np.uint64) + np.uint64(1), bits)])
    doc = np.concatenate([of_word, whose[: len(gram)][whole], of])
    return ids, doc, np.bincount(doc, minlength=n)


def _seen_before(words: np.ndarray, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of three words whether it came earlier in its document; and the document."""
    if len(words) < 3:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        window = words[:-2] * np.uint64(3) + (words[1:-1] ^ (words[1:-1] >> np.uint64(31))) * np.uint64(_BASE) + (words[2:] << np.uint64(7))
        window = (window ^ (window >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + whose[:-2].astype(np.uint64)
    inside = whose[:-2] == whose[2:]
    window, of = window[inside], whose[:-2][inside]
    order = np.argsort(window, kind="stable")
    seen = np.zeros(len(window), bool)
    seen[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    return seen, of


@dataclass(frozen=True)
class Model:
    #: Margin of class 1 over class 0 that a feature of each bucket adds, and the bias.
    weight: np.ndarray
    bias: float
    bits: int

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, doc, count = hashed(data, offsets, self.bits)
        total = np.bincount(doc, weights=self.weight[ids], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(texts: pa.Array, labels: np.ndarray, bits: int = 16, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 11) -> Model:
    """SGD over documents, linearly falling rate; embedding and softmax layer are learned together."""
    rng = np.random.default_rng(seed)
    table_ = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    rows = []
    data, offsets = utf8(texts)
    for i, j in slices(offsets, 1 << 19):
        ids, doc, _ = hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
        order = np.argsort(doc, kind="stable")
        for part in np.split(ids[order], np.cumsum(np.bincount(doc, minlength=j - i))[:-1]):
            key, n = np.unique(part, return_counts=True)
            small = np.uint16 if not len(n) or n.max() < 1 << 16 else np.uint32
            rows.append((key.astype(np.uint16 if bits <= 16 else np.int32), n.astype(small), len(part)))  # all that is held of a text
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            ids, n, size = rows[r]
            share = (n / max(1, size)).astype(np.float32)
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ table_[ids]
            margin = layer @ mean + bias
            p = np.exp(margin - margin.max())
            p /= p.sum()
            p[labels[r]] -= 1
            back = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= now * p
            # A bucket's vector moves with its share in the document, scaled so that rare features learn too.
            table_[ids] -= (now * dim * share)[:, None] * back[None, :]
    return Model((table_ @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


#: Part of the sample's bytes that one text may take.
LONGEST = 16


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8_000, max_bytes: int = 48 << 20, **training) -> Model:
    """Train on labelled documents in the order of their id's hash, as many as max_rows and max_bytes of text allow.

    Rows without a 0 or 1 label or without text, and texts of more than a LONGEST-th of max_bytes, are passed over: so LONGEST texts at least fit, if there are
    as many. The driver gets no more than max_rows labels and sizes, and then max_bytes of texts.
    """
    marked = labels.select(at(id_col).alias("doc_id"), at(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select(at(id_col).alias("doc_id"), at(text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_bytes // LONGEST)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.md5("text"), F.col("label")]
    rows = texts.join(F.broadcast(marked), "doc_id")  # at most max_rows are sent
    sizes = [r["n"] for r in rows.select(F.octet_length("text").alias("n"), *(c.alias(f"o{k}") for k, c in enumerate(order))).orderBy("o0", "o1", "o2", "o3").limit(max_rows).collect()]
    taken = int(np.searchsorted(np.cumsum(sizes), max_bytes, side="right"))
    rows = rows.orderBy(*order).limit(taken).select("text", "label").toArrow()
    model = train(rows.column("text").combine_chunks(), np.array(rows.column("label").to_pylist(), np.int64), **training)
    del rows
    release()
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs, and the score (0 to 1) of each whole text; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers, whatever the input

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                got = held.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, "score"])
        release()

    docs = docs.drop(score_col)
    source = docs.select(carried(docs, text_col).alias("row"), at(text_col).alias("text"))
    out = source.mapInArrow(work, StructType([*source.schema.fields, StructField("score", DoubleType())]))
    return out.select(*restored(docs, text_col, F.col("text")), F.col("score").alias(score_col))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows never learned from: crc32 of the id as text divisible by folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def is_held_out(doc_id: int, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out()))
    out = score_quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
