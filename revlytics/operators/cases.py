"""Evaluation cases from merged changes: faulty ones by reversing a fix, clean ones from ordinary changes; every refusal has its reason.

Checks of a row are one ordered CASE, cheap ones first. Only the diffs of rows that pass them are read by line: lines are numbered and runs of them become the expected
findings. A case has few changed lines, so all of it stays in its row, with neither a shuffle nor a filter that would work out the checks again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.functions import screening
from revlytics.functions.strings import strip
from revlytics.operators.diffs import added_in, file_chunks, lines_of, reverse_diff

# Limits of a fix, days until an ordinary change counts as clean, and what can't be reversed.
MOST_LINES, MOST_FILES, MOST_SPAN, CLEAN_DAYS = 20, 3, 10, 180
UNSUPPORTED = ("Binary files ", "GIT binary patch", "rename from ", "copy from ", "new file mode ", "deleted file mode ", "\\ No newline at end of file")
PULL = "key string, repository string, number long, title string, body string, merged_at timestamp, diff string, html_url string"


def _changed(line: Column) -> Column:
    return (line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))


def _is_code(text: Column) -> Column:
    return (strip(text) != "") & ~strip(text).startswith("#")


def _prepared(pulls: DataFrame, screened: Column) -> DataFrame:
    """pulls with code (their files of code as one diff), n_files, lines, and the reason of the first check that fails, up to the diff's shape."""
    chunks = file_chunks(F.col("diff"))
    rows = pulls.withColumn("screened", screened).withColumn("chunks", F.when(F.col("screened").isNull(), chunks))
    kept = F.filter("chunks", lambda c: c["path"].endswith(".py") & ~screening.is_test_path(c["path"]))
    rows = rows.withColumn("kept", kept).withColumn("code", F.array_join(F.col("kept.chunk"), "")).withColumn("lines", lines_of(F.col("code")))
    marker = F.lit(False)
    for m in UNSUPPORTED:
        marker = marker | F.contains("code", F.lit(m))
    reason = (
        F.when(F.col("screened").isNotNull(), F.col("screened")).when(strip(F.coalesce("diff", F.lit(""))) == "", "empty-diff").when(F.size("chunks") == 0, "unparsable-diff").when(marker, "unsupported-diff")
        .when(F.size("kept") > MOST_FILES, "too-many-files").when(F.size(F.filter("lines", _changed)) > MOST_LINES, "too-many-lines").when(F.size("kept") == 0, "no-production-python")
    )
    return rows.withColumns({"reason": reason, "n_files": F.size("kept")}).drop("chunks", "kept", "screened")


def _functions(lines: Column) -> Column:
    """Functions that a diff's hunks are in or that its changed lines define: one at least."""
    heading = lambda x: strip(F.regexp_extract(x, r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@\s*(.*)$", 1))
    name = lambda x: F.regexp_extract(x, f"(?U){screening.DEF_LINE}", 1)
    names = F.transform(lines, lambda x: F.when(x.rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), name(heading(x))).when(_changed(x), name(x)).otherwise(""))
    return F.greatest(F.lit(1), F.size(F.array_distinct(F.filter(names, lambda x: x != ""))))


def _as_of(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def _common(split: Column | str, cutoff, domain: str) -> list[Column]:
    return [
        F.col("repository"), F.col("number").alias("pull_request"), (split if isinstance(split, Column) else F.lit(split)).alias("split"), F.col("merged_at"), F.when(F.col("merged_at") < _as_of(cutoff), "pre-cutoff").otherwise("post-cutoff").alias("contamination_split"),
        F.lit(domain).alias("domain"), F.when(F.coalesce("html_url", F.lit("")) != "", F.col("html_url")).otherwise(F.concat(F.lit("https://github.com/"), "repository", F.lit("/pull/"), F.col("number").cast("string"))).alias("fix_pr_url"),
        F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("fix_pr_title"),
    ]


def _runs(spots: Column) -> Column:
    """array<path, start_line, end_line> of consecutive lines, of an ordered array<path, line> of distinct ones."""
    one = lambda path, start, end: F.struct(path.alias("path"), start.alias("start_line"), end.alias("end_line"))

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        goes_on = (last["path"] == x["path"]) & (last["end_line"] + 1 == x["line"])
        return F.when(goes_on, F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), one(last["path"], last["start_line"], x["line"]))).otherwise(F.array_append(a, one(x["path"], x["line"], x["line"])))

    return F.aggregate(spots, F.array().cast("array<struct<path: string, start_line: bigint, end_line: bigint>>"), step)


def built_cases(pulls: DataFrame, split: Column | str, cutoff, domain: str = "") -> DataFrame:
    """A row for each pull (columns of PULL, key unique): its case, with reason null, or the reason for which it is refused and a case of nulls.

    Reasons in the order of the checks: the title's (screening.screen_fix), empty-diff, unparsable-diff, unsupported-diff, too-many-files, too-many-lines,
    no-production-python, fix-adds-only, reversal-has-no-added-lines, seed-lines-blank-or-comment-only, release-commit, seed-span-too-wide, no-seed-findings.
    """
    rows = _prepared(pulls, screening.screen_fix(F.col("title"), F.col("body")))
    removes = F.exists("lines", lambda x: x.startswith("-") & ~x.startswith("---") & _is_code(F.substr(x, F.lit(2))))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(~removes, "fix-adds-only"))).withColumn("reverted", F.when(F.col("reason").isNull(), reverse_diff(F.col("code"))))
    # At most MOST_LINES of a case are added, so that they stay in its row.
    rows = rows.withColumn("added", added_in(F.col("reverted"))).withColumn("coded", F.array_sort(F.filter("added", lambda x: _is_code(x["content"]))))
    spots = F.filter("coded", lambda x: x["path"].endswith(".py") & ~screening.is_test_path(x["path"]))
    rows = rows.withColumn("runs", _runs(F.array_distinct(F.transform(spots, lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"))))))
    rows = rows.withColumns({"n_added": F.nullif(F.size("added"), F.lit(0)), "seeds": F.col("coded.content"), "span": F.array_max(F.transform("runs", lambda r: r["end_line"] - r["start_line"] + 1))})
    bumps = F.forall("seeds", lambda x: screening.found(x, screening.VERSION_ASSIGNMENT))
    later = (
        F.when(F.col("n_added").isNull(), "reversal-has-no-added-lines").when(F.size("seeds") == 0, "seed-lines-blank-or-comment-only").when(bumps, "release-commit")
        .when(F.col("span") > MOST_SPAN, "seed-span-too-wide").when(F.col("span").isNull(), "no-seed-findings")
    )
    rows = rows.withColumn("reason", F.coalesce("reason", later)).withColumn("d", F.when(F.col("reason").isNull(), screening.defect_class(F.array_join("seeds", "\n"), F.col("title"))))
    finding = lambda r: F.struct(r["path"].alias("path"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.col("d.cwe").alias("cwe"), F.col("d.severity").alias("severity"), F.lit(True).alias("should_comment"), F.col("d.name").alias("defect_class"))
    good = F.col("reason").isNull()
    case = {
        "id": F.concat(F.replace(F.col("repository"), F.lit("/"), F.lit("__")), F.lit("-pr-"), F.col("number").cast("string")), "diff": F.col("reverted"), "expected_findings": F.transform("runs", finding),
        "difficulty": screening.difficulty(F.col("seeds"), F.col("n_files"), _functions(F.col("lines")), F.col("d.name")), "defect_class": F.col("d.name"), "defect_class_basis": F.col("d.basis"), "rule_covered": F.col("d.rule_covered"),
        "label_provenance": screening.label_provenance(F.col("title"), F.col("body")), "human_patch": F.col("code"), "source_kind": F.lit("real-pr-reverted-fix"),
    }
    return rows.select("key", "reason", *_common(split, cutoff, domain), *(F.when(good, c).alias(n) for n, c in case.items()))


def built_clean_cases(pulls: DataFrame, split: Column | str, cutoff, as_of, domain: str = "") -> DataFrame:
    """As `built_cases`, for ordinary changes: the diff isn't reversed and nothing is expected of it.

    Reasons: the title's (screening.screen_clean), cooldown-not-elapsed (fewer than CLEAN_DAYS whole days from the merge to as_of), the diff's, no-added-lines.
    """
    days = F.floor((F.unix_seconds(_as_of(as_of)) - F.unix_seconds(F.col("merged_at"))) / 86400)
    screened = F.coalesce(screening.screen_clean(F.col("title"), F.col("body")), F.when(F.coalesce(days < CLEAN_DAYS, F.lit(True)), "cooldown-not-elapsed"))
    rows = _prepared(pulls, screened)
    none_added = F.when(F.col("reason").isNull(), F.size(added_in(F.col("code"))) == 0)
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(none_added, "no-added-lines")))
    none = lambda kind: F.lit(None).cast(kind)
    good = F.col("reason").isNull()
    case = {
        "id": F.concat(F.replace(F.col("repository"), F.lit("/"), F.lit("__")), F.lit("-pr-"), F.col("number").cast("string"), F.lit("-clean")), "diff": F.col("code"),
        "expected_findings": F.array().cast("array<struct<path: string, start_line: bigint, end_line: bigint, cwe: string, severity: string, should_comment: boolean, defect_class: string>>"),
        "difficulty": none("string"), "defect_class": none("string"), "defect_class_basis": none("string"), "rule_covered": none("boolean"), "label_provenance": none("string"), "human_patch": F.lit(""), "source_kind": F.lit("real-pr-clean"),
    }
    return rows.select("key", "reason", *_common(split, cutoff, domain), *(F.when(good, c).alias(n) for n, c in case.items()))
