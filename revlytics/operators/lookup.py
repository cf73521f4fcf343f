"""What a reviewer looks up: lines with a text, ranges of a file, tests that belong to a file, changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip
from revlytics.operators.folds import kept_lines

# Characters of a hit that are shown, lines and characters of a range, hits and tests that are listed.
HIT_CHARS, RANGE_LINES, RANGE_CHARS, MOST_HITS, MOST_TESTS = 500, 500, 40_000, 200, 100


def searched(lines: DataFrame, query: str, keys: list[str], most: int = 50) -> DataFrame:
    """keys, line, content of the first `most` lines (1 to MOST_HITS) by keys that hold the text, in any case. lines: keys, line, content. A blank query is an error."""
    wanted = query.strip().lower()
    if not wanted:
        raise ValueError("a query is needed")
    hits = lines.where(F.contains(F.lower("content"), F.lit(wanted))).select(*keys, "line", F.substring("content", 1, HIT_CHARS).alias("content"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return hits.withColumn("_n", first).where(F.col("_n") <= max(1, min(most, MOST_HITS))).drop("_n")  # a group limit


def read_range(content: Column, start: Column, end: Column) -> Column:
    """start_line, end_line, content of a range of a text: from line 1 at least, RANGE_LINES at most, RANGE_CHARS characters at most, and not beyond the text."""
    lines = kept_lines(F.coalesce(content, F.lit("")))
    low = F.greatest(F.lit(1), start)
    high = F.least(F.greatest(low, end), low + RANGE_LINES - 1)
    text = F.substring(F.array_join(F.slice(lines, low.cast("int"), (high - low + 1).cast("int")), ""), 1, RANGE_CHARS)
    return F.struct(low.cast("long").alias("start_line"), F.least(high, F.size(lines)).cast("long").alias("end_line"), text.alias("content"))


def located_tests(asked: DataFrame, files: DataFrame, keys: list[str], ask: str) -> DataFrame:
    """keys, ask, path, relevance: up to MOST_TESTS test files (of files: keys, path) for each question (keys, ask, path, symbol), most relevant first, then by path.

    A test file has test or spec in its path. Relevance counts which of the symbol, the file's stem and test_<stem> its path holds; with neither path nor symbol every test file counts, with 0.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.lower("path"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    has_path = F.coalesce("path", F.lit("")) != ""
    tokens = F.array_distinct(F.concat(F.when(F.coalesce("symbol", F.lit("")) != "", F.array(F.lower("symbol"))).otherwise(F.array().cast("array<string>")), F.when(has_path, F.array(stem, F.concat(F.lit("test_"), stem))).otherwise(F.array().cast("array<string>"))))
    q = asked.select(*keys, ask, tokens.alias("tokens"))
    tests = files.select(*keys, F.col("path"), F.lower("path").alias("low")).where("low like '%test%' or low like '%spec%'")
    score = F.size(F.filter("tokens", lambda t: (t != "") & F.contains(F.col("low"), t)))
    rows = q.join(tests, keys).withColumn("relevance", score).where((F.col("relevance") > 0) | (F.size("tokens") == 0))
    place = F.row_number().over(Window.partitionBy(*keys, ask).orderBy(F.desc("relevance"), "path"))
    return rows.withColumn("_n", place).where(F.col("_n") <= MOST_TESTS).select(*keys, ask, "path", "relevance")


def with_evidence(findings: DataFrame, added: DataFrame, keys: list[str], evidence: str = "evidence") -> DataFrame:
    """findings (keys, path, line, evidence) with evidence filled from the added line (keys, path, line, content) where it is blank, and found: whether the place is an added line. Of lines at one place the least content counts."""
    own = added.groupBy(*keys, "path", "line").agg(F.min("content").alias("_line"))
    rows = findings.join(own, [*keys, "path", "line"], "left")
    blank = strip(F.coalesce(evidence, F.lit(""))) == ""
    return rows.withColumns({evidence: F.when(blank, strip(F.col("_line"))).otherwise(F.col(evidence)), "found": F.col("_line").isNotNull()}).drop("_line")
