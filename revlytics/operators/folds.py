"""Greedy choices within a budget that aren't prefixes: what doesn't fit is skipped or shortened, and later rows may still fit.

Such a choice depends on all choices before it, so each case is read in order by one task, as a stream: a task holds what was
spent, the paths whose header is paid for, and a row, however many rows a case has. Cases are independent and run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip

#: The place after a line's end; fixed value as in diffs.py.
_AFTER_LINE = "(?<=\n|\r(?!\n)|[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029])"
#: What stands for lines that were left out of a hunk.
OMITTED = " ... [unchanged context omitted] ...\n"
#: A hunk isn't shortened to fewer bytes, and its added lines may take so much of what is left.
LEAST_BYTES, ADDED_SHARE = 128, 0.85
#: A required record isn't shortened to fewer bytes.
LEAST_RECORD = 48


def kept_lines(text: Column) -> Column:
    """Lines with their ends."""
    return F.filter(F.split(text, _AFTER_LINE, -1), lambda x: x != "")


def streamed(df: DataFrame, case: str, order: list[Column], start: Callable, schema: str) -> DataFrame:
    """Each case's rows, in order, through an object of `start()`: `.row(dict)` and `.end()` give output tuples (without the case)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(df.dtypes)[case]
    out = df.sparkSession.createDataFrame([], f"`{case}` {kind}, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        now, state, held = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if state is None or r[case] != now:
                    if state is not None:
                        held += [(now, *x) for x in state.end()]
                    now, state = r[case], start()
                held += [(now, *x) for x in state.row(r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(target)], [case, *names])
            held = []
        if state is not None:
            held = [(now, *x) for x in state.end()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], f.type) for i, f in enumerate(target)], [case, *names])

    return df.repartition(case).sortWithinPartitions(case, *order).mapInArrow(run, out)


def diff_hunks(diffs: DataFrame, case: str = "case_id", text: str = "diff") -> DataFrame:
    """case, hunk (from 0), path, header, text: a diff's hunks and what stands above a file's first one; a file without hunks is one. Cases have one diff each."""
    rows = diffs.select(case, F.posexplode(kept_lines(F.col(text))).alias("at", "raw"))
    raw = F.col("raw")
    so_far = Window.partitionBy(case).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(F.when(raw.startswith("--- ") & (F.col("at") > 0), 1).otherwise(0)).over(so_far))
    block = Window.partitionBy(case, "block")
    inside = block.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    path = F.regexp_replace(strip(F.substr(raw, F.lit(5))), "^b/", "")
    rows = rows.withColumns({
        "path": F.coalesce(F.last(F.when(raw.startswith("+++ "), path), True).over(block.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit("unknown")),
        "part": F.count_if(raw.startswith("@@")).over(inside), "place": F.row_number().over(block.orderBy("at")),
    })
    pieces = rows.groupBy(case, "block", "path", "part").agg(F.sort_array(F.collect_list(F.struct("at", "raw", "place"))).alias("t"))
    whole = lambda t: F.array_join(F.transform(t, lambda x: x["raw"]), "")
    parts = Window.partitionBy(case, "block")
    pieces = pieces.withColumn("parts", F.max("part").over(parts))
    bare = F.col("parts") == 0
    above = F.when(F.col("part") == 0, F.when(bare, whole(F.slice("t", 1, 2))).otherwise(whole(F.col("t"))))
    # A file that comes twice has the header of its last block.
    pieces = pieces.withColumn("header", F.coalesce(F.max_by(above, F.when(above.isNotNull(), F.col("block"))).over(Window.partitionBy(case, "path")), F.lit("")))
    hunks = pieces.where(bare | (F.col("part") > 0)).select(case, "block", "part", "path", "header", whole(F.col("t")).alias("text"))
    number = F.row_number().over(Window.partitionBy(case).orderBy("block", "part")) - 1
    return hunks.select(case, number.cast("long").alias("hunk"), "path", "header", "text")


def compact(text: str, limit: int, terms: tuple[str, ...], mark: str = OMITTED) -> str:
    """A hunk in at most `limit` bytes: its header, lines with a term and their neighbours, then added lines while there is room."""
    lines = text_lines(text)
    if limit < LEAST_BYTES or not lines:
        return ""
    size = [len(x.encode()) for x in lines]
    chosen = {0}
    for i, x in enumerate(lines):
        if any(t in x.lower() for t in terms):
            chosen |= {max(0, i - 1), i, min(len(lines) - 1, i + 1)}
    risky = lambda x: any(t in x.lower() for t in terms)
    spent, room = sum(size[i] for i in chosen), max(LEAST_BYTES, int(limit * ADDED_SHARE))
    for i, x in enumerate(lines):
        if x.startswith("+") and not x.startswith("+++") and not risky(x):
            if spent + size[i] > room:
                break
            chosen.add(i)
            spent += size[i]
    out, used, last = [], 0, None
    for i in sorted(chosen):
        if last is not None and i > last + 1 and used + len(mark.encode()) <= limit:
            out.append(mark)
            used += len(mark.encode())
        if used + size[i] > limit:
            break
        out.append(lines[i])
        used += size[i]
        last = i
    return "".join(out)


def text_lines(text: str) -> list[str]:
    return text.splitlines(True)


class _Hunks:
    def __init__(self, budget: int, terms: tuple[str, ...], mark: str):
        self.budget, self.terms, self.mark = budget, terms, mark
        self.used, self.paid, self.over, self.first, self.any = 0, set(), False, None, False

    def row(self, r: dict) -> list[tuple]:
        out = self.choose(r)
        if self.any or self.first is None:
            held = [] if self.first is None or not self.any else [(self.first["hunk"], "dropped", None)]
            if not self.any:  # the best hunk waits: it is all there is if nothing fits
                self.first = r
                return []
            self.first = None
            return held + out
        return out

    def choose(self, r: dict) -> list[tuple]:
        header, size = 0 if r["path"] in self.paid else len(r["header"].encode()), len(r["text"].encode())
        if not self.over:
            kept, text = "kept", r["text"]
            if self.used + header + size > self.budget:
                kept, text = "compacted", compact(r["text"], self.budget - self.used - header, self.terms, self.mark)
            if kept == "kept" or text:
                self.any = True
                self.used += header + len(text.encode())
                self.paid.add(r["path"])
            if kept == "compacted":
                self.over = self.used >= self.budget
            if kept == "kept" or text:
                return [(r["hunk"], kept, text)]
        return [(r["hunk"], "dropped", None)]

    def end(self) -> list[tuple]:
        if self.first is None:
            return []
        text = compact(self.first["text"], self.budget, self.terms, self.mark) or self.first["text"][: self.budget]
        return [(self.first["hunk"], "compacted", text)]


def chosen_hunks(hunks: DataFrame, budget: int, terms: tuple[str, ...] = (), case: str = "case_id", mark: str = OMITTED) -> DataFrame:
    """case, hunk, decision, text for every hunk (case, hunk, path, header, text, score): kept, compacted or dropped.

    The highest score comes first, of equal ones the lower number; a path's header is paid for once. Without any that fits the first is shortened. terms: lower-case.
    """
    rows = hunks.select(case, "hunk", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("header", F.lit("")).alias("header"), F.coalesce("text", F.lit("")).alias("text"), "score")
    return streamed(rows, case, [F.desc("score"), F.col("hunk")], lambda: _Hunks(budget, terms, mark), "hunk long, decision string, text string")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4)).cast("long")


def bounded_diffs(diffs: DataFrame, most_tokens: int, terms: tuple[str, ...], score: Callable[[Column, Column], Column], case: str = "case_id", text: str = "diff", mark: str = OMITTED) -> DataFrame:
    """case, text, compressed, tokens, omitted_files, omitted_hunks: diffs within a budget of tokens (four bytes each), hunks in their order under their headers."""
    known = diffs.select(case, F.coalesce(text, F.lit("")).alias("diff"))
    long_ = known.where(token_estimate(F.col("diff")) > most_tokens)
    hunks = diff_hunks(long_, case, "diff").withColumn("score", score(F.col("path"), F.col("text")))
    got = chosen_hunks(hunks, max(1024, most_tokens * 4), terms, case, mark).withColumnRenamed("text", "shown")
    rows = hunks.select(case, "hunk", "path", "header").join(got, [case, "hunk"])
    taken = rows.where("decision <> 'dropped'")
    before = F.lag("path").over(Window.partitionBy(case).orderBy("hunk"))
    piece = F.concat(F.when(before.eqNullSafe(F.col("path")), "").otherwise(F.col("header")), "shown")
    taken = taken.select(case, F.struct("hunk", piece.alias("piece")).alias("x"), "path")
    texts = taken.groupBy(case).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["piece"]), "").alias("joined"), F.count_distinct("path").alias("n_paths"), F.count("*").alias("n_hunks"))
    whole = rows.groupBy(case).agg(F.count_distinct("path").alias("all_paths"), F.count("*").alias("all_hunks"))
    short = texts.join(whole, case).select(case, F.concat(strip(F.col("joined")), F.lit("\n")).alias("text"), F.lit(True).alias("compressed"), (F.col("all_paths") - F.col("n_paths")).alias("omitted_files"), (F.col("all_hunks") - F.col("n_hunks")).alias("omitted_hunks"))
    none = F.lit(0).cast("long")
    full = known.where(token_estimate(F.col("diff")) <= most_tokens).select(case, F.col("diff").alias("text"), F.lit(False).alias("compressed"), none.alias("omitted_files"), none.alias("omitted_hunks"))
    return full.unionByName(short).withColumn("tokens", token_estimate(F.col("text")))


class _Records:
    def __init__(self, budget: int):
        self.budget, self.used = budget, 0

    def row(self, r: dict) -> list[tuple]:
        data, left = (r["text"] or "").encode(), self.budget - self.used
        if len(data) <= left:
            self.used += len(data)
            return [(r["place"], "kept", r["text"] or "")]
        cut = "" if r["optional"] or left < LEAST_RECORD else data[:left].decode("utf-8", "ignore")
        if not cut:
            return [(r["place"], "dropped", None)]
        self.used += len(cut.encode()) + 1
        return [(r["place"], "clipped", cut + "\n")]

    def end(self) -> list[tuple]:
        return []


def packed_records(records: DataFrame, budget: int, case: str = "case_id") -> DataFrame:
    """case, place, decision, text of records (case, place, text, optional) in their order: those that fit are kept, others dropped, a required one clipped to whole characters."""
    return streamed(records.select(case, "place", "text", F.coalesce("optional", F.lit(False)).alias("optional")), case, [F.col("place")], lambda: _Records(budget), "place long, decision string, text string")
