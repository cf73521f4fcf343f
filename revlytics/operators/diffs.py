"""Unified diffs as line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import once, strip

#: Fixed value: a hunk's header, with the first of its new lines.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
#: Fixed value: what ends a line, CRLF first.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def lines_of(text: Column) -> Column:
    """Lines without their ends; no empty one after a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def added_lines(diffs: DataFrame, case: str = "case_id", text: str = "diff") -> DataFrame:
    """case, path, line, content of every added line; one shuffle by row, a window over a diff's lines.

    A hunk's lines are numbered from its header's second range; context lines (empty ones too) count, removed ones and the mark of a
    missing final line end don't. A file header ends a hunk. Rows are told apart, so a case_id may have several diffs.
    """
    # The number only keeps a row's lines together, so it may differ from run to run.
    rows = diffs.select(case, text, F.monotonically_increasing_id().alias("_row"))
    rows = rows.select(case, "_row", F.posexplode(lines_of(F.col(text))).alias("at", "raw"))
    so_far = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.col("raw")
    hunk = F.regexp_extract("raw", HUNK, 1)
    is_hunk, is_file = hunk != "", raw.startswith("+++ ")
    name = F.regexp_replace(strip(F.substring("raw", 5, 1 << 20)), "^b/", "")
    rows = rows.withColumns({
        "path": F.last(F.when(is_file, name), True).over(so_far),
        "state": F.last(F.when(is_file, F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("first"))).when(is_hunk, F.struct(F.lit(True).alias("inside"), hunk.cast("long").alias("first"))), True).over(so_far),
        "part": F.sum(F.when(is_file | is_hunk, 1).otherwise(0)).over(so_far),
    })
    added = raw.startswith("+") & ~raw.startswith("+++")
    skipped = (raw.startswith("-") & ~raw.startswith("---")) | raw.startswith("\\ No newline")
    counted = F.when(is_hunk | is_file | (skipped & ~added), 0).otherwise(1).cast("long")
    inside = Window.partitionBy("_row", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", F.col("state.first") + F.sum(counted).over(inside) - 1)
    return rows.where(added & ~is_file & F.col("state.inside")).select(case, F.when(F.col("path") != "", F.col("path")).otherwise("unknown").alias("path"), "line", F.substring("raw", 2, 1 << 30).alias("content"))


def added_in(text: Column) -> Column:
    """array<path, line, content> of a diff's added lines, as `added_lines` has them: for diffs of few of them, since a row holds all."""
    none = F.array().cast("array<struct<path: string, line: bigint, content: string>>")
    start = F.struct(F.lit(None).cast("string").alias("path"), F.lit(False).alias("inside"), F.lit(0).cast("long").alias("line"), none.alias("found"))
    state = lambda path, inside, line, found: F.struct(path.alias("path"), inside.alias("inside"), line.alias("line"), found.alias("found"))

    def step(a: Column, x: Column) -> Column:
        found = F.struct(F.when(a["path"] != "", a["path"]).otherwise("unknown").alias("path"), a["line"].alias("line"), F.substring(x, 2, 1 << 30).alias("content"))
        return (
            F.when(x.startswith("+++ "), state(F.regexp_replace(strip(F.substring(x, 5, 1 << 20)), "^b/", ""), F.lit(False), F.lit(1).cast("long"), a["found"]))
            .when(x.startswith("@@ ") & x.rlike(HUNK), state(a["path"], F.lit(True), F.regexp_extract(x, HUNK, 1).cast("long"), a["found"]))
            .when((x.startswith("-") & ~x.startswith("---")) | x.startswith("\\ No newline"), a)
            .when(a["inside"] & x.startswith("+") & ~x.startswith("+++"), state(a["path"], a["inside"], a["line"] + 1, F.array_append(a["found"], found)))
            .otherwise(state(a["path"], a["inside"], a["line"] + 1, a["found"]))
        )

    return F.aggregate(lines_of(text), start, step, lambda a: a["found"])


def file_chunks(diff: Column) -> Column:
    """array<path, chunk> of a diff's files."""
    whole = F.array_join(F.transform(lines_of(F.coalesce(diff, F.lit(""))), lambda x: F.concat(x, F.lit("\n"))), "")
    parts = F.filter(F.split(whole, r"(?md)^(?=diff --git a/.+? b/.)", -1), lambda x: x.rlike(r"^diff --git a/.+? b/."))
    return F.transform(parts, lambda x: F.struct(strip(F.regexp_extract(x, r"(?d)^diff --git a/.+? b/(.+)\n", 1)).alias("path"), x.alias("chunk")))


def split_by_file(diffs: DataFrame, case: str = "case_id", text: str = "diff") -> DataFrame:
    """case, at (from 0), path, chunk: a diff's text from one file header to the next; the path is the new one."""
    rows = diffs.select(case, F.posexplode(file_chunks(F.col(text))).alias("at", "file"))
    return rows.select(case, F.col("at").cast("long").alias("at"), "file.path", "file.chunk")


def change_fingerprint(text: Column) -> Column:
    """SHA-1 of the changed lines with their file headers, without trailing blanks; hunk headers, index lines and context don't count."""
    changed = F.filter(lines_of(text), lambda x: x.startswith("+") | x.startswith("-"))
    return F.sha1(F.array_join(F.transform(changed, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))


def reverse_diff(text: Column) -> Column:
    """The diff that undoes a diff: signs and ranges swapped, index lines dropped. Applied twice it gives the diff back."""

    def turn(line: Column) -> Column:
        return (
            F.when(line.rlike("^--- a/"), F.concat(F.lit("+++ b/"), F.substring(line, 7, 1 << 20)))
            .when(line.rlike(r"^\+\+\+ b/"), F.concat(F.lit("--- a/"), F.substring(line, 7, 1 << 20)))
            .when(line.rlike("^@@ "), F.regexp_replace(line, r"^@@ -(\S+) \+(\S+) @@", r"@@ -$2 +$1 @@"))
            .when(line.startswith("+"), F.concat(F.lit("-"), F.substring(line, 2, 1 << 30)))
            .when(line.startswith("-"), F.concat(F.lit("+"), F.substring(line, 2, 1 << 30)))
            .otherwise(line)
        )

    kept = F.filter(lines_of(text), lambda x: ~x.rlike("^(index|similarity index) "))
    turned = F.transform(kept, turn)
    # A header pair comes in the order ---, +++ again. Lines are turned once: an expression inside a lambda is worked out again for each element.
    ordered = lambda all_: F.transform(all_, lambda x, i: F.when(x.startswith("+++ b/") & F.coalesce(F.get(all_, i + 1).startswith("--- a/"), F.lit(False)), F.get(all_, i + 1))
                                       .when(x.startswith("--- a/") & F.coalesce(F.get(all_, i - 1).startswith("+++ b/"), F.lit(False)), F.get(all_, i - 1)).otherwise(x))
    return once(turned, lambda all_: F.concat(F.array_join(ordered(all_), "\n"), F.lit("\n")))


def content_fingerprint(text: Column) -> Column:
    """SHA-1 of the lines without trailing blanks."""
    return F.sha1(F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x)), "\n"))
