"""Texts and paths: prefixes bounded in bytes, normalised paths, outcomes of test logs, scored hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.functions.strings import GAP, strip
from revlytics.operators.diffs import lines_of

# What the words of test runners mean.
RUNNER_WORDS = {"PASSED": "passed", "FAILED": "failed", "ERROR": "failed", "SKIPPED": "skipped", "XFAIL": "skipped", "XPASS": "skipped"}
UNIT_WORDS = {"ok": "passed", "OK": "passed", "FAIL": "failed", "ERROR": "failed", "skipped": "skipped", "expected failure": "skipped", "unexpected success": "skipped"}
#: Path parts that make a hunk risky.
RISKY_PATHS = ("auth", "security", "payment", "migration")


def utf8_prefix(text: Column, limit: Column) -> Column:
    """The longest prefix of whole characters in at most `limit` bytes; a character has four at most, so three steps back are enough."""
    cut = [F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(limit - k, F.lit(0))).cast("string") for k in range(4)]
    return F.coalesce(*(F.when(F.is_valid_utf8(c), c) for c in cut))


def cause_path(path: Column) -> Column:
    """A path for comparison: one kind of separator, `.` and inner `..` resolved, lower-case; empty for the root and the current folder.

    A `..` that leaves the repository stays; dots at the start of names too.
    """
    flat = F.regexp_replace(strip(F.coalesce(path, F.lit(""))), r"[\\/]+", "/")
    rooted = flat.startswith("/")
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        open_ = (F.size(kept) > 0) & F.coalesce(F.element_at(kept, -1) != "..", F.lit(False))
        return (
            F.when(part.isin("", "."), kept).when((part == "..") & open_, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when((part == "..") & rooted, kept).otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.aggregate(F.split(flat, "/", -1), empty, step)
    return F.lower(F.when(F.size(parts) == 0, "").otherwise(F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))))


def _named(words: dict[str, str], word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), word)


def _node_id(word: Column, whole: bool) -> Column:
    """The node id `file.py::part::part` that a word is (whole) or begins with, with forward slashes; null without one."""
    pieces = F.split(word, "::", -1)
    file = F.get(pieces, 0)
    is_file = file.endswith(".py") & (F.length(file) > 3) & ~file.rlike(r"(?U)[^\w./\\-]")
    names = F.slice(pieces, F.lit(2), F.size(pieces))
    if whole:
        kept = F.when(F.forall(names, lambda x: (x != "") & ~F.contains(x, F.lit(":"))), names)
    else:  # up to the first part that is empty or has a colon, which ends it
        start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))
        cut = lambda x: F.substring_index(x, ":", 1)
        step = lambda a, x: F.struct((a["open"] & ~F.contains(x, F.lit(":"))).alias("open"), F.when(a["open"] & (cut(x) != ""), F.concat(a["kept"], F.array(cut(x)))).otherwise(a["kept"]).alias("kept"))
        stops = lambda a, x: F.when(x == "", F.struct(F.lit(False).alias("open"), a["kept"].alias("kept"))).otherwise(step(a, x))
        kept = F.aggregate(names, start, stops, lambda a: a["kept"])
    return F.when(is_file & (F.size(kept) > 0), F.replace(F.concat_ws("::", file, kept), F.lit("\\"), F.lit("/")))


def _outcome_of_unit(rest: Column) -> Column:
    """What stands after `name (dotted)`: perhaps a note in brackets, three dots, an outcome."""
    noted = rest.startswith("[") & F.contains(rest, F.lit("]"))
    after = F.when(noted, F.substr(rest, F.locate("]", rest) + 1)).otherwise(F.concat(F.lit(" "), rest))
    gap, dots = strip(F.substr(after, F.lit(1), F.lit(1))) == "", strip(after)
    said = F.substr(dots, F.lit(4))
    fits = gap & dots.startswith("...") & (strip(F.substr(said, F.lit(1), F.lit(1))) == "") & (said != "")
    outcome = F
    for word, meaning in UNIT_WORDS.items():
        outcome = outcome.when(strip(said).startswith(word) & ~F.substr(strip(said), F.lit(len(word) + 1), F.lit(1)).rlike(r"(?U)\w"), meaning)
    return F.when(fits, outcome)


def test_outcomes(logs: DataFrame, key: str, text: str) -> DataFrame:
    """key, test, outcome of each test that a log names; of several outcomes of one test failed wins, then passed.

    Lines are read word by word. Three kinds count: a node id and its outcome, an outcome and its node id, and `name (dotted) ... outcome`,
    whose id is the dotted name with the test's own once. White space is Unicode's, names may have any letters. Partial maxima, one
    shuffle by log and test.
    """
    first, second, rest = (F.col(c) for c in ("first", "second", "rest"))
    lead = lambda w: _named(RUNNER_WORDS, F.regexp_extract(w, r"(?U)^\w+", 0))
    row = lambda test, outcome: F.when(test.isNotNull() & outcome.isNotNull(), F.struct(test.alias("test"), outcome.alias("outcome")))
    dotted = F.substr(second, F.lit(2), F.greatest(F.length(second) - 2, F.lit(0)))
    is_unit = second.startswith("(") & second.endswith(")") & (dotted != "") & ~dotted.rlike(r"(?U)[^\w.]") & (first != "") & ~first.rlike(r"(?U)\W")
    unit = F.when(is_unit, F.when(F.endswith(dotted, F.concat(F.lit("."), first)), dotted).otherwise(F.concat_ws(".", dotted, first)))
    found = F.coalesce(row(_node_id(first, True), lead(second)), row(_node_id(second, False), _named(RUNNER_WORDS, first)), row(unit, _outcome_of_unit(rest)))
    lines = logs.select(key, F.explode(lines_of(F.col(text))).alias("raw")).select(key, strip(F.col("raw")).alias("raw"))
    # Each step is a column of its own, worked out once. Lines of no kind end as the test null: a filter before the sum would work out all of it a second time.
    lines = lines.select(key, F.split("raw", GAP, 3).alias("words")).select(key, *(F.coalesce(F.get("words", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(("first", "second", "rest"))))
    lines = lines.select(key, found.alias("f"))
    rank = F.when(F.col("f.outcome") == "failed", 3).when(F.col("f.outcome") == "passed", 2).otherwise(1)
    return lines.groupBy(key, F.col("f.test").alias("test")).agg(F.max_by(F.col("f.outcome"), rank).alias("outcome")).where("outcome is not null")


def hunk_score(path: Column, hunk: Column, terms: tuple[str, ...]) -> Column:
    """2 a term that path or hunk holds, a quarter an added line up to 8, 6 for a risky path."""
    low = F.lower(F.concat(path, F.lit("\n"), hunk))
    held = sum((F.contains(low, F.lit(t)).cast("double") * 2 for t in terms), F.lit(0.0))
    added = F.size(F.filter(lines_of(hunk), lambda x: x.startswith("+") & ~x.startswith("+++")))
    return held + F.least(F.lit(8.0), added * F.lit(0.25)) + F.when(F.lower(path).rlike("|".join(RISKY_PATHS)), 6.0).otherwise(0.0)
