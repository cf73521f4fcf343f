"""Rows that cover most of stated queries' tokens, without exchanging a row for each token that they share.

The queries (a stated set, in blocks of BLOCK) go to every task as an index from token to queries. A task counts, for each of its rows, how many tokens of each query the row has, and
keeps the best few for each query; only these are exchanged. So a token that all rows share costs an addition, not a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that are sent to tasks at a time, and the bytes of a token pattern's matches that count.
BLOCK = 4096
TOKEN = r"[a-z0-9_./:-]{2,}"


def _best(batches: Iterator[pa.RecordBatch], index: dict[bytes, np.ndarray], sizes: np.ndarray, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    token = re.compile(TOKEN.encode())
    best: list[list[tuple]] = [[] for _ in sizes]
    least = np.zeros(len(sizes), np.int64)  # shared tokens of the k-th best so far
    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if row is None or not text:
                continue
            hits = [index[t] for t in set(token.findall(text.encode())) if t in index]
            if not hits:
                continue
            count = np.bincount(np.concatenate(hits), minlength=len(sizes))
            for q in np.flatnonzero((count > 0) & (count >= least)).tolist():
                held = best[q]
                held.append((-int(count[q]), row))
                held.sort()
                del held[k:]
                if len(held) == k:
                    least[q] = -held[-1][0]
    rows = [(q, row, -n) for q, held in enumerate(best) for n, row in held]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["q", "row", "shared"])


def best_covering(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, row, shared, size of the k rows (id, text) that share most distinct tokens with each query (id, text); ties by the lower row. A row without any isn't one of them.

    Ids are unique; nulls are passed over. The driver holds BLOCK queries at a time.
    """
    spark, out = rows.sparkSession, None
    kind, of = rows.schema["id"].dataType, queries.schema["id"].dataType.simpleString()
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0))
    asked = queries.where("id is not null").select("id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    lower = rows.select("id", F.lower("text").alias("text"))

    def answered(block: list) -> DataFrame:
        index: dict[bytes, list] = {}
        for q, r in enumerate(block):
            for t in r["tokens"]:
                index.setdefault(t.encode(), []).append(q)
        lists = {t: np.array(v, np.int64) for t, v in index.items()}
        sizes = np.array([len(r["tokens"]) for r in block], np.int64)
        found = lower.mapInArrow(lambda batches: _best(batches, lists, sizes, k, to_arrow_type(kind)), f"q int, row {kind.simpleString()}, shared long")
        names = spark.createDataFrame([(q, r["id"], len(r["tokens"])) for q, r in enumerate(block)], f"q int, query {of}, size int")
        return found.join(F.broadcast(names), "q")  # at most BLOCK rows

    block: list = []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            out, block = (answered(block) if out is None else out.unionByName(answered(block))), []
    if block or out is None:
        out = answered(block) if out is None else out.unionByName(answered(block))
    order = Window.partitionBy("query").orderBy(F.desc("shared"), "row")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "row", "shared", "size")
