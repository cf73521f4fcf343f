"""Predictions against truth intervals: edges by an equi-join with a residual, and matchers per case.

Edges are joined on the case and a bin of lines: a truth stands in each bin that its widened interval touches, a prediction in its own. So a case with many
of both makes no more rows than lie near each other.
`max_matching`: maximum matching by shortest augmenting paths, truths with the fewest edges first. `nearest_matching`:
each truth in order takes the nearest prediction left, of equally near ones that of the higher rank. They differ where two truths compete for one prediction.
`in_turn_matching`: each prediction in order takes the first truth left, in an order that the caller gives.
Edges whose both ends have no other edge are settled by a window of counts; only contested ones reach the Python kernels, a case after the other as a stream.
Cases that fall into independent parts (paths, islands of lines) can be given these parts as further keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from revlytics.functions.metrics import interval_distance


#: Lines of a bin, at least.
BIN = 16


def edges(predicted: DataFrame, truth: DataFrame, on: list[str], tolerance: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """predicted(on, p, line) x truth(on, t, start, end) -> on, p, t, distance within the tolerance, and the carried columns of either; nulls are near nothing."""
    far = interval_distance(F.col("line"), F.col("start"), F.col("end"))
    width = max(BIN, 2 * tolerance + 1)
    place = lambda line: F.floor(line / width)
    # An interval that ends before it begins is no nearer to any line than its ends.
    low, high = F.least("start", "end") - tolerance, F.greatest("start", "end") + tolerance
    own = lambda df: [c for c in carry if c in df.columns]
    spread = truth.where("start is not null and end is not null").select(*on, "t", "start", "end", *own(truth)).withColumn("_bin", F.explode(F.sequence(place(low), place(high))))
    return predicted.select(*on, "p", "line", *own(predicted)).withColumn("_bin", place(F.col("line"))).join(spread, [*on, "_bin"]).withColumn("distance", far).where(F.col("distance") <= tolerance).select(*on, "p", "t", "distance", *carry)


def islands(truth: DataFrame, on: list[str], tolerance: int = 2) -> DataFrame:
    """on, island, low, high: runs of lines that widened truths cover; matchings in different islands don't touch."""
    wide = truth.select(*on, (F.col("start") - tolerance).alias("low"), (F.greatest("start", "end") + tolerance).alias("high"))
    order = Window.partitionBy(*on).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = wide.withColumn("_new", F.when(F.col("low") > F.coalesce(reach, F.col("low") - 1), 1).otherwise(0)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*on, "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def max_matching(rows: list[tuple[int, int, int]]) -> dict[int, int]:
    """t -> p for edges (p, t, distance); each truth is placed along a shortest alternating path, found level by level."""
    options = defaultdict(list)
    for p, t, *_ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        options[t].append(p)
    of_p: dict[int, int] = {}
    of_t: dict[int, int] = {}
    for start in sorted(options, key=lambda t: (len(options[t]), t)):
        came, level, end = {}, [start], None
        while level and end is None:
            following = []
            for t in level:
                for p in options[t]:
                    if p in came:
                        continue
                    came[p] = t
                    if p not in of_p:
                        end = p
                        break
                    following.append(of_p[p])
                if end is not None:
                    break
            level = following
        while end is not None:  # turn the path round
            t = came[end]
            before = of_t.get(t)
            of_t[t], of_p[end] = end, t
            end = before
    return of_t


def nearest_matching(rows: list[tuple]) -> dict[int, int]:
    """t -> p for edges (p, t, distance, rank of p; none: all alike)."""
    options = defaultdict(list)
    for p, t, d, *rank in rows:
        options[t].append((d, -(rank[0] if rank else 0), p))
    out, used = {}, set()
    for t in sorted(options):
        free = min((x for x in options[t] if x[2] not in used), default=None)
        if free:
            out[t] = free[2]
            used.add(free[2])
    return out


def in_turn_matching(rows: list[tuple]) -> dict[int, int]:
    """t -> p for edges (p, t, distance, turn of p, rank of t): predictions by turn, then number, each take the truth of the least rank left. Maximum where ranks rise with the truths' ends and turns are lines."""
    options = defaultdict(list)
    for p, t, _, turn, rank in rows:
        options[turn, p].append((rank, t))
    out: dict[int, int] = {}
    for turn, p in sorted(options):
        free = min((x for x in options[turn, p] if x[1] not in out), default=None)
        if free:
            out[free[1]] = p
    return out


def match(found: DataFrame, case: str | list[str], kernel, rank: str | list[str] | None = None) -> DataFrame:
    """case, t, p of the matching that a kernel chooses in each case (one key or several); rank: a column, or several, that the kernel gets with each edge."""
    keys = [case] if isinstance(case, str) else list(case)
    by_p, by_t = Window.partitionBy(*keys, "p"), Window.partitionBy(*keys, "t")
    ranks = [rank] if isinstance(rank, str) else rank or []
    named = [f"_rank{i}" for i in range(len(ranks))]
    rows = found.select(*keys, "p", "t", "distance", *(F.col(c).alias(n) for c, n in zip(ranks, named)))
    counted = rows.withColumns({"_p": F.count("*").over(by_p), "_t": F.count("*").over(by_t)})
    alone = (F.col("_p") == 1) & (F.col("_t") == 1)
    names = [*keys, "t", "p"]
    schema = counted.select(*keys, F.col("t").cast("long"), F.col("p").cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            out.extend((*now, t, p) for t, p in kernel(held).items())

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                key = row[: len(keys)]
                if key != now:
                    if held:
                        close()
                    now, held = key, []
                held.append(row[len(keys) :])
            if out:
                yield made(out)
                out = []
        if held:
            close()
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to_arrow_schema(schema))], names)

    contested = counted.where(~alone).select(*keys, "p", "t", "distance", *named)
    chosen = contested.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)
    return counted.where(alone).select(*keys, F.col("t").cast("long"), F.col("p").cast("long")).unionByName(chosen)
