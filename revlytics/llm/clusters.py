"""Centroid clustering of vectors in exact integers, screened in float32.

Components become integers floor(scale * x). A batch of vectors meets all centroids in one float32 matrix product; the rounding
error of each product is bounded rigorously, so that |c|^2 - 2xc is known to lie in an interval. Only centroids whose interval
reaches below the least upper end stay; where several do, their distances are computed anew in 64-bit integers and the lowest
number wins a tie. So results don't depend on batches, on the machine's matrix library or on the order of rows.

Bounds. A component is less than 2^27 in size (else the job fails: 64-bit distances couldn't hold it). With u = 2^-24, reading x and
c as float32 and summing d products in any order, fused or not, errs by at most g * |x| * |c|, g = (d + 2)u / (1 - (d + 2)u). Norms and
the interval's ends are computed in float64 and widened by 2^-40 of their size.

A round reads the written integers once, each task sums its vectors by centroid (at most k (d + 1) numbers a task), and Spark adds these up. The
driver holds k centroids and nothing else; k and d are parameters, not data.

Kept are vectors of exactly `dims` components without null, NaN or infinity; others are left out. Fewer vectors than k give fewer
centroids. A null id is hashed as the empty string and never preferred: it comes after all others. Repeated rows are vectors each; of
starting vectors with one hash (one id) the one with smaller packed bytes comes first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import at, discard, passing, stage, table

LIMIT = 1 << 27
#: Vectors that a matrix product takes at a time.
BLOCK = 4096


def integers(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id and the kept vectors' components as little-endian 32-bit integers."""
    x = at(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where((F.size(x) == dims) & whole).select(at(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.floor(scale * b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if np.abs(v).max() >= LIMIT:
                raise ValueError(f"a component times {scale} is {LIMIT} or more: distances wouldn't fit 64 bits")
            rows = v.astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "x"])

    return kept.mapInArrow(pack, "vec_id long, x binary")


def starting(packed: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash, in its order: k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = packed.select(F.col("vec_id").isNull().alias("none"), name.alias("name"), "x").orderBy("none", "name", "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of x (64-bit integers), lowest number first."""
    k, d = centroids.shape
    unit = 2.0**-24
    g = (d + 2) * unit / (1 - (d + 2) * unit)
    wider = 1 + 2.0**-40
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    norms = (centroids * centroids).sum(1)
    x_size, c_size = np.sqrt((x * x).sum(1).astype(np.float64)) * wider, np.sqrt(norms.astype(np.float64)) * wider
    # 2^-40 of the terms' size covers the rounding of this line and of the next two.
    error = 2 * g * wider * x_size[:, None] * c_size[None, :] + 2.0**-40 * (norms[None, :] + 2 * np.abs(product))
    middle = norms[None, :].astype(np.float64) - 2 * product
    open_ = middle - error <= (middle + error).min(1, keepdims=True)
    best = open_.argmax(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    if len(unsure):
        exact = np.full((len(unsure), k), np.iinfo(np.int64).max)
        for j in range(k):
            rows = open_[unsure, j]
            exact[rows, j] = distances(x[unsure[rows]], centroids[j])
        best[unsure] = exact.argmin(1)
    return best


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            yield part.column("vec_id"), np.frombuffer(b"".join(part.column("x").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _sums(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Centroid -> count and componentwise sums of its vectors, for those that have any."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _blocks(batches, dims):
            best = nearest(x, centroids)
            for j in np.unique(best).tolist():
                mine = best == j
                count[j] += int(mine.sum())
                total[j] += x[mine].sum(0)
        some = np.flatnonzero(count)
        held = np.column_stack([count, total])[some]  # a centroid's count, then its sums
        place = np.tile(np.arange(dims + 1, dtype=np.int32), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(place), pa.array(held.reshape(-1))], ["cluster", "place", "total"])

    parts = packed.mapInArrow(add, "cluster int, place int, total long")
    out = np.zeros((k, dims + 1), object)
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # at most k * (dims + 1)
        out[r["cluster"], r["place"]] = int(r["total"])
    return {j: (n, total) for j, (n, *total) in enumerate(out.tolist()) if n}


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dims):
            best = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distances(x, centroids[best]))], ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(place, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of each kept vector, and the final centroids."""
    packed = stage(integers(vectors, id_col, vector_col, dims, scale), "vectors")
    centroids = starting(packed, k, dims, seed)
    if not len(centroids):
        return packed.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for j, (n, total) in _sums(packed, centroids).items():
            moved[j] = [s // n for s in total]
        if (moved == centroids).all():  # later rounds would change nothing
            break
        centroids = moved
    out = stage(assigned(packed, centroids), "assigned")
    discard(packed)
    return out, centroids


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    with passing(spark) as kept:
        out, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
        kept.append(out)
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values or [None])), F.col("cluster") + 1)
    return out.withColumns({
        "cluster_inertia": pick([inertia.get(j, 0) for j in range(len(names))], "long"),
        "inertia": F.lit(sum(inertia.values())).cast("long"),
        "centroid_sha256": pick(names, "string"),
    })


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""v as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x from embeddings
               where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims})""",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as j, x from v qualify j < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, v.x, arg_min(j, cast({gap} as hugeint) * 1000 + j) as j, cast(min({gap}) as bigint) as d from v, c{r} as c group by vec_id, v.x)")
        if r < rounds:
            steps.append(f"""m{r} as (select j, i, sum(x[i]) as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by j, i)""")
            steps.append(f"""c{r + 1} as materialized (select c.j, coalesce(f.x, c.x) as x from c{r} as c left join
               (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from m{r} group by j) as f on f.j = c.j)""")
    return f"""with {", ".join(steps)}
select vec_id, cast(a.j as int) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.j) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
       sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} as a join c{rounds} as c on c.j = a.j"""


SQL = _sql()
