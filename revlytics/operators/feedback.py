"""People's feedback on the way to new cases: worksheets merged, confirmed labels imported, cases promoted and written, causes triaged.

Every row gets one outcome with its reason; nothing is left out silently. Joins are on ids and repositories; what is counted is counted by partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip
from revlytics.functions.texts import cause_path
from revlytics.operators.diffs import added_lines

# Labels that each kind of candidate may have, and the category of those that are feedback.
ALLOWED_LABELS = {
    "unmatched_finding": ("valid", "valid-but-noise", "invalid", "unlabelled"),
    "unmatched_expected": ("should-have-caught", "not-expected", "unlabelled"),
}
LABEL_CATEGORY = {"invalid": "false_positive", "should-have-caught": "missed_issue"}
# Categories that people confirm, those with no rule of promotion, and the two that have one.
CONFIRMED = ("false_positive", "missed_issue", "bad_fix", "accepted")
REFUSED = ("bad_fix", "accepted", "execution_error")
POSITIVE, CLEAN = "missed_issue", "false_positive"
HIDDEN_SPLIT = "holdout"
#: Limits of a case's name and of its diff's bytes.
NAME_CHARS, DIFF_BYTES = 120, 1 << 20
_SEVERITIES = ("low", "medium", "high", "critical")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def worksheet_merged(candidates: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with a worksheet's labels, and (candidate_id, outcome) of its entries: applied, blank, same, conflict or unknown.

    candidates: candidate_id (once each), label, note, rule_id, any others; entries: candidate_id (once each), label, note, rule_id. A label that is there is never
    overwritten; an unknown id means that the worksheet belongs to another list, so a caller should stop.
    """
    e = entries.select("candidate_id", F.struct("label", "note", "rule_id").alias("_e"))
    both = candidates.join(e, "candidate_id", "left")
    writes = F.col("_e").isNotNull() & ~_blank(F.col("_e.label")) & _blank(F.col("label"))
    kept = {"label": F.when(writes, F.col("_e.label")).otherwise(F.col("label")), "note": F.when(writes, F.coalesce("_e.note", F.lit(""))).otherwise(F.col("note")), "rule_id": F.when(writes & ~_blank(F.col("_e.rule_id")), F.col("_e.rule_id")).otherwise(F.col("rule_id"))}
    merged = both.select(*(kept.get(c, F.col(c)).alias(c) for c in candidates.columns))
    held = candidates.select("candidate_id", F.struct(F.col("label")).alias("_c"))
    outcome = (
        F.when(F.col("_c").isNull(), "unknown").when(_blank(F.col("label")), "blank").when(_blank(F.col("_c.label")), "applied")
        .when(F.col("_c.label") == F.col("label"), "same").otherwise("conflict")
    )
    return merged, entries.join(held, "candidate_id", "left").select("candidate_id", outcome.alias("outcome"))


def imported(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """candidates (at, candidate_id, kind, label, ...) with outcome and category: unconfirmed, rejected, not_feedback, already_imported or imported.

    present: candidate_id of what was imported before; of one id's rows that could be imported the first by `at` is.
    """
    pairs = [(k, v) for k, labels in ALLOWED_LABELS.items() for v in labels]
    allowed = F.lit(False)
    for k, v in pairs:
        allowed = allowed | ((F.col("kind") == k) & (F.col("label") == v))
    category = F.element_at(F.create_map(*(F.lit(x) for pair in LABEL_CATEGORY.items() for x in pair)), F.col("label"))
    rows = candidates.withColumn("outcome", F.when(_blank(F.col("label")), "unconfirmed").when(~F.coalesce(allowed, F.lit(False)), "rejected").when(category.isNull(), "not_feedback"))
    before = present.select("candidate_id").distinct().withColumn("_here", F.lit(True))
    first = rows.where("outcome is null").groupBy("candidate_id").agg(F.min("at").alias("_first"))
    rows = rows.join(before, "candidate_id", "left").join(first, "candidate_id", "left")
    late = F.col("_here").isNotNull() | (F.col("at") > F.col("_first"))
    outcome = F.coalesce("outcome", F.when(late, "already_imported").otherwise("imported"))
    return rows.withColumn("outcome", outcome).withColumn("category", F.when(F.col("outcome") == "imported", category)).drop("_here", "_first")


def repository_splits(corpus: DataFrame) -> DataFrame:
    """repository, split of a corpus; raises where a repository is on two sides. Cases without a repository don't count."""
    sides = corpus.where(~_blank(F.col("repository"))).groupBy("repository").agg(F.min("split").alias("split"), F.max("split").alias("_other"))
    crosses = F.raise_error(F.concat(F.lit("a repository is in two splits: "), F.col("repository"))).cast("string")
    return sides.select("repository", F.when(F.col("split") == F.col("_other"), F.col("split")).otherwise(crosses).alias("split"))


def promotions(feedback: DataFrame, corpus: DataFrame, prefix: str = "confirmed") -> DataFrame:
    """A row for each piece of feedback: reason (null: promoted), and the case that it becomes: name, split, diff, expected.

    feedback: id, category, case_id, candidate_id, path, line, severity, rule_id. corpus: id, repository, split, diff, n_expected; ids are
    unique. Reasons in the order of the checks: unconfirmed-category, refused-category, no-rule, unknown-case, unknown-repository, hidden-split, clean-source-has-defects,
    no-severity, no-place, diff-too-large, no-added-lines, not-an-added-line, unknown-severity. expected is an array of at most one finding; a clean case expects none.
    """
    splits = repository_splits(corpus)
    known = corpus.select(F.col("id").alias("case_id"), F.struct("repository", "diff", "n_expected").alias("c"))
    rows = feedback.join(known, "case_id", "left").join(splits.select(F.col("repository").alias("_r"), "split"), F.col("c.repository") == F.col("_r"), "left").drop("_r")
    severity, clean = F.lower(strip(F.coalesce("severity", F.lit("")))), F.col("category") == CLEAN
    early = (
        F.when(~F.coalesce(F.col("category").isin(*CONFIRMED), F.lit(False)), "unconfirmed-category").when(F.col("category").isin(*REFUSED), "refused-category").when(~F.col("category").isin(POSITIVE, CLEAN), "no-rule")
        .when(F.col("c").isNull(), "unknown-case").when(F.col("split").isNull(), "unknown-repository").when(F.col("split") == HIDDEN_SPLIT, "hidden-split").when(clean & (F.col("c.n_expected") > 0), "clean-source-has-defects")
        .when(~clean & (severity == ""), "no-severity").when(~clean & (F.col("path").isNull() | F.col("line").isNull()), "no-place").when(F.octet_length(F.coalesce("c.diff", F.lit(""))) > DIFF_BYTES, "diff-too-large")
    )
    rows = rows.withColumn("reason", early)
    # Each diff that is asked for is taken apart once, however many pieces of feedback are about it.
    asked = rows.where("reason is null").select("case_id").distinct()
    lines = added_lines(corpus.join(asked, corpus["id"] == asked["case_id"], "left_semi").select(F.col("id").alias("case_id"), "diff"), "case_id", "diff").select("case_id", "path", "line").distinct()
    some = lines.groupBy("case_id").agg(F.lit(True).alias("_some"))
    rows = rows.join(some, "case_id", "left").join(lines.withColumn("_added", F.lit(True)), ["case_id", "path", "line"], "left")
    late = F.when(F.col("_some").isNull(), "no-added-lines").when(~clean & F.col("_added").isNull(), "not-an-added-line").when(~clean & ~severity.isin(*_SEVERITIES), "unknown-severity")
    rows = rows.withColumn("reason", F.coalesce("reason", late))
    finding = F.struct("path", "line", severity.alias("min_severity"), F.nullif(strip(F.coalesce("rule_id", F.lit(""))), F.lit("")).alias("rule_id"))
    expected = F.filter(F.array(F.when(~clean, finding)), lambda x: x.isNotNull())
    own = F.when(_blank(F.col("candidate_id")), F.col("id").cast("string")).otherwise(F.col("candidate_id"))
    name = F.substring(F.concat_ws("-", F.lit(prefix), "category", own), 1, NAME_CHARS)
    good = F.col("reason").isNull()
    return rows.select("id", "category", "case_id", "reason", *(F.when(good, x).alias(n) for n, x in (("name", name), ("split", F.col("split")), ("repository", F.col("c.repository")), ("diff", F.col("c.diff")), ("expected", expected))))


def plan_summary(promoted: DataFrame) -> DataFrame:
    """One row: promoted, refused, clean, and counts by split, category and reason as maps."""
    good = F.col("reason").isNull()
    by = lambda c: promoted.groupBy(F.lit(c).alias("what"), F.col(c).alias("of")).agg(F.count("*").alias("n")).where("of is not null")
    kept = promoted.where(good)
    counts = by("reason").unionByName(kept.groupBy(F.lit("split").alias("what"), F.col("split").alias("of")).agg(F.count("*").alias("n"))).unionByName(kept.groupBy(F.lit("category").alias("what"), F.col("category").alias("of")).agg(F.count("*").alias("n")))
    maps = counts.groupBy().agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("what") == w, F.struct("of", "n"))))).alias(f"by_{w}") for w in ("split", "category", "reason")))
    total = promoted.agg(F.count_if(good).alias("promoted"), F.count_if(~good).alias("refused"), F.count_if(good & (F.size("expected") == 0)).alias("clean"))
    return total.crossJoin(maps)  # one row each


def written(plan: DataFrame, existing: DataFrame, content: list[str]) -> DataFrame:
    """plan (name, content columns, at) with outcome: written, existing (the same content is there under the name) or conflict (another is).

    Names are immutable: what comes first under a name stays, in the table or, by `at`, in the plan.
    """
    here = existing.select("name", F.struct(*content).alias("_old")).groupBy("name").agg(F.min("_old").alias("_old"))
    first = plan.groupBy("name").agg(F.min_by(F.struct(*content), "at").alias("_new"), F.min("at").alias("_first"))
    rows = plan.join(here, "name", "left").join(first, "name")
    held = F.coalesce("_old", "_new")
    same = F.struct(*content).eqNullSafe(held)
    outcome = F.when(~same, "conflict").when(F.col("_old").isNull() & (F.col("at") == F.col("_first")), "written").otherwise("existing")
    return rows.withColumn("outcome", outcome).drop("_old", "_new", "_first")


def cause(category: Column, rule_id: Column, path: Column) -> Column:
    """A root cause's fingerprint: category and rule in any case, and the path as causes are compared, with a unit separator between them."""
    plain = lambda c: strip(F.coalesce(c, F.lit("")))
    parts = F.concat_ws("\x1f", F.lower(plain(category)), F.upper(plain(rule_id)), cause_path(path))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 16)


def triaged(feedback: DataFrame, attempts: DataFrame, least: int, most_attempts: int) -> DataFrame:
    """feedback (id, category, cause) with fate: inferred, attempted, exhausted, selected or sporadic.

    attempts: id, cause, run_id of what was tried. Only what people confirmed and wasn't tried yet is learned from; a cause tried in most_attempts runs is given up (0: never), one
    seen in fewer than `least` confirmed pieces, tried ones included, waits.
    """
    seen = feedback.where(F.col("category").isin(*CONFIRMED)).groupBy("cause").agg(F.count("*").alias("_seen"))
    runs = attempts.groupBy("cause").agg(F.count_distinct("run_id").alias("_runs"))
    done = attempts.select("id").distinct().withColumn("_done", F.lit(True))
    rows = feedback.join(seen, "cause", "left").join(runs, "cause", "left").join(done, "id", "left")
    fate = (
        F.when(~F.coalesce(F.col("category").isin(*CONFIRMED), F.lit(False)), "inferred").when(F.col("_done").isNotNull(), "attempted")
        .when(F.lit(most_attempts > 0) & (F.coalesce("_runs", F.lit(0)) >= most_attempts), "exhausted").when(F.coalesce("_seen", F.lit(0)) >= least, "selected").otherwise("sporadic")
    )
    return rows.withColumn("fate", fate).drop("_seen", "_runs", "_done")


def prior_attempts(attempts: DataFrame, causes: DataFrame, baseline: Column, most: int) -> DataFrame:
    """attempts (row, cause, run_id, baseline) of the given causes on the same baseline, with place and considered: causes tried most often first, then the latest; `most` of them (0: all).

    The first `most` places are taken in each task before they meet.
    """
    runs = attempts.groupBy("cause").agg(F.count_distinct("run_id").alias("tries"))
    rows = attempts.where(F.col("baseline") == baseline).join(causes.select("cause").distinct(), "cause", "left_semi").join(runs, "cause")
    place = F.row_number().over(Window.orderBy(F.desc("tries"), F.desc("row")))
    kept = rows.orderBy(F.desc("tries"), F.desc("row")).limit(most) if most else rows
    return kept.withColumn("place", place.cast("long")).crossJoin(rows.agg(F.count("*").alias("considered")))  # one row
