"""Lines changed between two texts, by a shortest edit script in linear space.

A pair of texts is one record; pairs are aligned in Arrow batches inside tasks. Common ends and lines that the other text hasn't are set aside; the rest is
divided at the middle of a shortest path (forward and backward frontiers, one array step for a whole frontier) until nothing is
shared. Memory is a few numbers a line, time grows with lines times edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from revlytics.functions.strings import strip
from revlytics.operators.diffs import lines_of

_NONE = -(1 << 40)
#: Pairs that a task aligns before it gives them back.
PAIRS = 64


def _step(front: np.ndarray, zero: int, d: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves a frontier (furthest x of each diagonal x - y) on by an edit and along equal lines; the diagonals, and where equal lines began."""
    n, m = len(a), len(b)
    low, high = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)
    k = np.arange(low, high + 1, 2)
    if d == 0:
        x = np.zeros(1, np.int64)
    else:
        down, right = front[zero + k + 1], front[zero + k - 1] + 1
        x = np.maximum(np.where(down - k <= m, down, _NONE), np.where(right <= n, right, _NONE))
    began, open_ = x.copy(), np.flatnonzero(x >= 0)
    while len(open_):
        open_ = open_[(x[open_] < n) & (x[open_] - k[open_] < m)]
        open_ = open_[a[x[open_]] == b[x[open_] - k[open_]]]
        x[open_] += 1
    front[zero + k] = x
    return k, began


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Where a run of equal lines in the middle of a shortest script begins and ends: x, y, u, v. Texts have neither a common first nor last line."""
    n, m = len(a), len(b)
    gap, most = n - m, (n + m + 1) // 2
    zero = most + 1
    ahead, back = (np.full(2 * most + 3, _NONE, np.int64) for _ in range(2))
    ra, rb = a[::-1], b[::-1]
    for d in range(most + 1):
        for own, other, p, q, from_end in ((ahead, back, a, b, False), (back, ahead, ra, rb, True)):
            k, began = _step(own, zero, d, p, q)
            reach = d - 1 if not from_end else d
            if (gap % 2 == 1) == from_end:
                continue
            facing = gap - k
            seen = (facing >= -reach) & (facing <= reach)
            met = np.flatnonzero(seen)[own[zero + k[seen]] + other[zero + facing[seen]] >= n]
            if len(met):
                i = met[0]
                x, u, kk = int(began[i]), int(own[zero + k[i]]), int(k[i])
                return (x, x - kk, u, u - kk) if not from_end else (n - u, m - (u - kk), n - x, m - (x - kk))
    raise AssertionError("frontiers always meet")


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each line of a its partner in b, or -1: a longest common subsequence."""
    partner = np.full(len(a), -1, np.int64)
    ia, ib = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    todo = [(0, len(ia), 0, len(ib))]
    sa, sb = a[ia], b[ib]
    while todo:
        i, j, p, q = todo.pop()
        n = min(j - i, q - p)
        if not n:
            continue
        same = sa[i : i + n] != sb[p : p + n]
        lead = int(same.argmax()) if same.any() else n
        partner[ia[i : i + lead]] = ib[p : p + lead]
        i, p = i + lead, p + lead
        n = min(j - i, q - p)
        differ = sa[j - n : j][::-1] != sb[q - n : q][::-1]
        tail = int(differ.argmax()) if n and differ.any() else n
        partner[ia[j - tail : j]] = ib[q - tail : q]
        j, q = j - tail, q - tail
        if i < j and p < q:
            x, y, u, v = _middle(sa[i:j], sb[p:q])
            partner[ia[i + x : i + u]] = ib[p + y : p + v]
            todo += [(i, i + x, p, p + y), (i + u, j, p + v, q)]
    return partner


def changed_blocks(partner: np.ndarray, n_after: int) -> list[tuple[int, int, int, int]]:
    """Runs between matched lines: lines before (from, to) and after (from, to), ends exclusive."""
    x = np.concatenate([[-1], np.flatnonzero(partner >= 0), [len(partner)]])
    y = np.concatenate([[-1], partner[partner >= 0], [n_after]])
    cut = np.flatnonzero((np.diff(x) > 1) | (np.diff(y) > 1))
    return [(int(x[i]) + 1, int(x[i + 1]), int(y[i]) + 1, int(y[i + 1])) for i in cut]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("i1", "i2", "j1", "j2")]))
    for b in (whole.slice(i, PAIRS) for whole in batches for i in range(0, whole.num_rows, PAIRS)):
        out = []
        for before, after in zip(b.column("before"), b.column("after")):
            ids = pa.concat_arrays([before.values, after.values]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            n = len(before.values)
            out.append([dict(zip(("i1", "i2", "j1", "j2"), x)) for x in changed_blocks(matched(ids[:n], ids[n:]), len(ids) - n)])
        # What is given back is a few pairs' own, so that neither their lines nor their blocks pile up until a whole batch is done.
        kept = [c for c in b.schema.names if c != "before"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, kind)], [*kept, "blocks"])


def aligned(pairs: DataFrame, before: Column, after: Column, keep: list[str]) -> DataFrame:
    """The named columns, after as lines, and blocks: array<i1, i2, j1, j2> of what changed. A null text has no lines."""
    none = F.array().cast("array<string>")
    rows = pairs.select(*keep, F.coalesce(lines_of(before), none).alias("before"), F.coalesce(lines_of(after), none).alias("after"))
    return rows.mapInArrow(_align, StructType([*rows.drop("before").schema, StructField("blocks", DataType.fromDDL("array<struct<i1: int, i2: int, j1: int, j2: int>>"))]))


#: Lines to either side of a finding that its fix may change.
WINDOW = 5


def patch_scope(pairs: DataFrame, before: Column, after: Column, line: str, keep: list[str], window: int = WINDOW) -> DataFrame:
    """keep, changed_lines, out_of_scope (arrays of lines before), import_insertions, passed.

    A pure insertion counts as the line that it comes before. Blocks that only insert imports are allowed anywhere. Nothing changed passes.
    """
    rows = aligned(pairs, before, after, [*keep, line] if line not in keep else keep)
    new = lambda b: F.slice("after", b["j1"] + 1, b["j2"] - b["j1"])
    is_import = lambda x: strip(x).startswith("import ") | strip(x).startswith("from ")
    imports = lambda b: (b["i1"] == b["i2"]) & (b["j2"] > b["j1"]) & F.forall(new(b), is_import)
    lines = lambda b: F.sequence(b["i1"] + 1, F.greatest(b["i2"], b["i1"] + 1))
    rows = rows.withColumn("marked", F.transform("blocks", lambda b: F.struct(lines(b).alias("lines"), imports(b).alias("imports"))))
    every = lambda blocks: F.array_sort(F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["lines"]))))
    outside = F.filter(every(F.filter("marked", lambda b: ~b["imports"])), lambda x: (x < F.col(line) - window) | (x > F.col(line) + window))
    rows = rows.withColumns({"changed_lines": every(F.col("marked")), "out_of_scope": outside, "import_insertions": F.size(F.filter("marked", lambda b: b["imports"])).cast("long")})
    return rows.select(*keep, "changed_lines", "out_of_scope", "import_insertions", (F.size("out_of_scope") == 0).alias("passed"))
