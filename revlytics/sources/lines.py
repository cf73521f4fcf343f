"""Text files by line, with each line's number in its file however the file is split among tasks.

A task reads a block of a file from its first whole line. Lines are numbered within their block as they are read; the blocks' line counts, summed in
the order of their places in the file, give the number of each block's first line. So there is one pass for the counts (a row a block) and one for the lines,
and no file is read by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (its place in the file), order (ascending within a block), value."""
    rows = spark.read.text(path)
    # The id counts a task's rows as they are read; a task reads its blocks one after another.
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"), "value")


def numbered_lines(spark: SparkSession, path: str | list[str], keep=None, in_parts: bool = False) -> DataFrame:
    """file, line (from 1), value of the lines of text files, or of those for which keep(value) holds: only these are joined with the blocks' counts.

    in_parts: the files of a folder are one file in parts, in the order of their names, as a job writes them: lines are numbered on from part to part. file is the part's.
    Lines end with LF, CRLF or CR; blank ones count. Compressed files are one block each. Files must not change meanwhile.
    """
    rows = _blocks(spark, path)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    whole = F.regexp_extract("file", "^(.*)/", 1) if in_parts else F.col("file")
    before = Window.partitionBy(whole).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    lines = rows if keep is None else rows.where(keep(F.col("value")))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("order") - F.col("first") + 1).alias("line"), "value")


def not_json(value):
    """A line that isn't blank and isn't JSON."""
    return (strip(value) != "") & F.try_parse_json(value).isNull()


def read_strict(spark: SparkSession, path: str | list[str], schema: str, id_col: str | None = None) -> DataFrame:
    """Rows of JSON-lines files; raises `path:line` of the first line (by file and number) that isn't JSON, and the least id that comes twice, if ids are asked for.

    Blank lines are passed over. The check is a pass of its own that brings one row to the driver.
    """
    bad = numbered_lines(spark, path, not_json).orderBy("file", "line").head(1)
    if bad:
        raise ValueError(f"{bad[0]['file'].removeprefix('file://')}:{bad[0]['line']}: not JSON")
    rows = spark.read.text(path).where(strip(F.col("value")) != "").select(F.from_json("value", schema).alias("x")).select("x.*")
    if id_col and (twice := rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").orderBy(id_col).head(1)):
        raise ValueError(f"{id_col} comes {twice[0]['n']} times: {twice[0][0]}")
    return rows
