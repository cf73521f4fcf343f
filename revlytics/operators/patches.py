"""Strict unified patches as line tables: parsed, verified against their files, applied as a whole or not at all.

A patch is a table of its lines with the file and hunk that they belong to; what is wrong with it is a column. Old lines (context and
removed ones) meet the files' lines in one full outer join on file and line number, so that files and patches of any length are
verified line by line over all tasks. The new text is what is left: file lines that aren't removed, and added lines between them.
The first thing that is wrong, in the order in which a reader would meet it, voids all of a case's files.

Rules: between `--- ` and `+++ ` headers of one allowed path stand hunks; each line of a hunk begins with a blank, a plus, a minus or a
backslash (which doesn't count); numbers of old and new lines must be the header's; hunks must not overlap nor begin after the file's
end; old lines must be the file's. A range without old lines begins at its line, so `-4,0` adds before line 4. A file ends with a line end
if it did before. Text outside files, files without hunks, files named twice and paths that leave the repository are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip
from revlytics.operators.diffs import lines_of

_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@"
#: What is wrong, by the reason given.
REASONS = (
    "content outside a file header", "no new-file header", "path not allowed", "unsafe path", "invalid hunk header", "invalid patch line", "line counts differ",
    "file without hunks", "no file patches", "file named twice", "several patches", "overlapping or out of range", "context differs",
)


def _name(line: Column, mark: str) -> Column:
    """The path of a header line: up to a tab, without its mark."""
    path = F.substring_index(F.substr(line, F.lit(5)), "\t", 1)
    return F.when(path.startswith(mark), F.substr(path, F.lit(len(mark) + 1))).otherwise(path)


def _wrong(at: Column, reason: str, phase: int = 0, minor: int = 0) -> Column:
    return F.struct(F.lit(phase).alias("phase"), at.cast("long").alias("at"), F.lit(minor).alias("minor"), F.lit(reason).alias("reason"))


def parsed(patches: DataFrame, case: str = "case_id", text: str = "patch") -> DataFrame:
    """A row for each line of a case's patch: case, at (from 0), op, text, path, file, hunk, old_line, target, old_count, cursor, wrong.

    op is blank, + or - for lines of hunks, else null. old_line: for old lines their number in the file, for added ones that of the old
    line before them. target and cursor are the file's lines before the hunk, by its header and by the hunk before.
    """
    one = patches.groupBy(case).agg(F.count("*").alias("n"), F.min(text).alias("text"))
    lines = F.coalesce(lines_of(F.col("text")), F.array().cast("array<string>"))
    rows = one.select(case, "n", F.posexplode_outer(lines).alias("at", "raw"))
    rows = rows.withColumns({"at": F.coalesce("at", F.lit(0)), "raw": F.coalesce("raw", F.lit(""))})
    raw, all_ = F.col("raw"), Window.partitionBy(case).orderBy("at")
    so_far = all_.rowsBetween(Window.unboundedPreceding, 0)
    is_file, is_hunk = raw.startswith("--- "), raw.startswith("@@ ")
    after_file = F.coalesce(F.lag(is_file).over(all_), F.lit(False))
    rows = rows.withColumns({
        "is_new": after_file, "is_last": F.lead("at").over(all_).isNull(), "state": F.last(F.when(is_file, "file").when(is_hunk, "hunk"), True).over(so_far), "file": F.sum(F.when(is_file, 1).otherwise(0)).over(so_far),
        "hunk": F.sum(F.when(is_hunk, 1).otherwise(0)).over(so_far), "old_path": F.last(F.when(is_file, _name(raw, "a/")), True).over(so_far), "path": F.last(F.when(after_file, _name(raw, "b/")), True).over(so_far),
    })
    # A file's header line still has the path of the file before; only the name of its own file counts.
    rows = rows.withColumn("path", F.when(~(is_file & ~F.col("is_new")), F.col("path")))
    sign = F.substr(raw, F.lit(1), F.lit(1))
    in_hunk = (F.col("state") == "hunk") & ~is_hunk & ~F.col("is_new")
    rows = rows.withColumn("op", F.when(in_hunk & sign.isin(" ", "+", "-"), sign))
    part = lambda k, none: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("raw", _HEADER, k), F.lit("")), F.lit("999999999999999999")).cast("long"), F.lit(none).cast("long"))
    fits = raw.rlike(_HEADER)
    head = F.when(is_hunk & fits, F.struct((part(1, 0) - 1).alias("target"), part(2, 1).alias("old"), part(3, 1).alias("new")))
    is_old, is_added = F.coalesce(F.col("op").isin(" ", "-"), F.lit(False)), F.coalesce(F.col("op").isin(" ", "+"), F.lit(False))
    whole = Window.partitionBy(case, "file", "hunk")
    inside = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": F.first(head, True).over(whole), "seen": F.sum(F.when(is_old, 1).otherwise(0)).over(inside)}).withColumns({
        "old_count": F.sum(F.when(is_old, 1).otherwise(0)).over(whole), "new_count": F.sum(F.when(is_added, 1).otherwise(0)).over(whole), "end": F.max("at").over(whole), "old_line": F.col("head.target") + F.col("seen"),
    })
    # Files, whose hunks follow each other: the lines that a hunk's header has before it are those up to the end of the last.
    of_file = Window.partitionBy(case, "file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "cursor": F.coalesce(F.last(F.when(is_hunk, F.col("head.target") + F.col("old_count")), True).over(of_file), F.lit(0).cast("long")),
        "hunks": F.count_if(is_hunk).over(Window.partitionBy(case, "file")), "file_end": F.max("at").over(Window.partitionBy(case, "file")),
        "same_path": F.count_if(F.col("is_new")).over(Window.partitionBy(case, "path")),
    })
    at = F.col("at")
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/", -1), "..")
    of_line = (
        F.when(F.col("file") == 0, F.when(strip(raw) != "", _wrong(at, REASONS[0])))
        .when(F.col("is_new"), F.when(~raw.startswith("+++ "), _wrong(at, REASONS[1])).when(F.col("path") != F.col("old_path"), _wrong(at, REASONS[2])).when(unsafe, _wrong(at, REASONS[3], 0, 1)))
        .when(is_file, F.when(F.col("is_last"), _wrong(at, REASONS[1], 0, 1)))
        .when(is_hunk, F.when(~fits, _wrong(at, REASONS[4])))
        .when(F.col("state") == "file", F.when(raw != "\\ No newline at end of file", _wrong(at, REASONS[4])))
        .when(~sign.isin(" ", "+", "-", "\\"), _wrong(at, REASONS[5]))
    )
    counts = F.when((F.col("file") > 0) & is_hunk & fits & ((F.col("old_count") != F.col("head.old")) | (F.col("new_count") != F.col("head.new"))), _wrong(F.col("end"), REASONS[6], 0, 2))
    empty = F.when(is_file & (F.col("hunks") == 0), _wrong(F.greatest(F.col("file_end"), at + 1), REASONS[7], 0, 3))
    last = F.lit(1 << 40)
    of_patch = F.when(F.col("n") > 1, _wrong(F.lit(-1), REASONS[10])).when((at == 0) & (F.max("file").over(Window.partitionBy(case)) == 0), _wrong(last, REASONS[8]))
    twice = F.when(F.col("is_new") & (F.col("same_path") > 1), _wrong(last, REASONS[9], 0, 1))
    overlap = F.when(is_hunk & (F.col("head.target") < F.col("cursor")), _wrong(at, REASONS[11], 1))
    wrong = F.array_min(F.array_compact(F.array(of_line, counts, empty, of_patch, twice, overlap)))
    return rows.select(case, "at", "op", F.substr(raw, F.lit(2)).alias("text"), "path", "is_new", is_hunk.alias("is_hunk"), "file", "hunk", F.col("old_line"), F.col("head.target").alias("target"), "old_count", "cursor", wrong.alias("wrong"))


def apply_patches(patches: DataFrame, files: DataFrame, case: str = "case_id", patch: str = "patch", path: str = "path", content: str = "content") -> DataFrame:
    """case, path, content of each patched file of cases whose patch fits; a row with reason and line (of the patch, from 1) for others.

    patches: case, patch; files: case, path, content. A null patch is an empty one, a null content an empty file. Of several files with one path that with the
    smallest content counts. Backslashes of the files' paths count as slashes.
    """
    held = files.join(patches.select(case).distinct(), case, "left_semi")
    held = held.groupBy(case, F.replace(F.col(path), F.lit("\\"), F.lit("/")).alias("path")).agg(F.min(F.coalesce(content, F.lit(""))).alias("content"))
    known = held.select(case, "path", F.size(lines_of(F.col("content"))).alias("n_file"), F.col("content").endswith("\n").alias("ends"))
    lines = parsed(patches, case, patch).join(known, [case, "path"], "left")
    at = F.col("at")
    unknown = F.when(F.col("is_new") & F.col("n_file").isNull(), _wrong(at, REASONS[2]))
    beyond = F.when(F.col("is_hunk") & (F.col("target") > F.col("n_file")), _wrong(at, REASONS[11], 1))
    lines = lines.withColumn("wrong", F.array_min(F.array_compact(F.array("wrong", unknown, beyond))))
    is_old = F.coalesce(F.col("op").isin(" ", "-"), F.lit(False))
    # All of the patch's lines go into the join, so that they are made once; those that aren't old have no line to meet and pass through.
    old = lines.select(case, "path", F.when(is_old, F.col("old_line")).alias("line"), F.struct("at", "op", "text", "wrong", "old_line", "is_new", is_old.alias("is_old")).alias("old"))
    own = held.select(case, "path", F.posexplode(lines_of(F.col("content"))).alias("line", "own"))
    own = own.withColumn("line", (F.col("line") + 1).cast("long"))
    met = own.join(old, [case, "path", "line"], "full")
    differs = F.when(F.col("old.is_old") & ~F.coalesce(F.col("own") == F.col("old.text"), F.lit(False)), _wrong(F.col("old.at"), REASONS[12], 1, 1))
    keep = F.when(F.coalesce(F.col("old.op") != "-", F.lit(True)) & F.col("own").isNotNull(), F.struct("line", F.lit(-1).alias("at"), F.col("own").alias("text")))
    added = F.when(F.col("old.op") == "+", F.struct(F.col("old.old_line").alias("line"), F.col("old.at").alias("at"), F.col("old.text").alias("text")))
    touched = F.coalesce(F.col("old.is_old") | F.col("old.is_new"), F.lit(False))
    met = met.select(case, "path", F.coalesce(keep, added).alias("new"), F.array_min(F.array_compact(F.array("old.wrong", differs))).alias("wrong"), touched.alias("touched"))
    by_file = met.groupBy(case, "path").agg(F.sort_array(F.collect_list("new")).alias("new"), F.min("wrong").alias("wrong"), F.bool_or("touched").alias("touched")).where("touched or wrong is not null")
    # A case that is refused keeps one of its rows, for the reason; so neither kind needs a pass of its own.
    of_case = Window.partitionBy(case)
    by_file = by_file.withColumns({"wrong": F.min("wrong").over(of_case), "nth": F.row_number().over(of_case.orderBy("path"))}).where("wrong is null or nth = 1").join(known.select(case, "path", "ends"), [case, "path"], "left")
    text = F.concat(F.array_join("new.text", "\n"), F.when(F.col("ends"), "\n").otherwise(""))
    good = F.col("wrong").isNull()
    where = F.when((F.col("wrong.at") >= 0) & (F.col("wrong.at") < 1 << 40), F.col("wrong.at") + 1)
    return by_file.select(case, F.when(good, F.col("path")).alias("path"), F.when(good, text).alias("content"), F.col("wrong.reason").alias("reason"), where.alias("line"))
