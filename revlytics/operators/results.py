"""Results of cases: findings matched to what was expected, severities, repairs, and a run's totals and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.metrics import f1_of_rounded, ratio
from revlytics.functions.review import SEVERITY_RANK
from revlytics.operators import matching

# What became of a repair, and severities that count as high.
REPAIR_TIERS = ("verified-draft", "blocked", "suggestion-only", "unreproduced")
HIGH = ("high", "critical")
COUNTS = ("expected", "predicted", "tp", "fp", "fn", "severity_hits", "high_total", "high_hits")


def severity_rank(severity: Column) -> Column:
    """low 1 to critical 4; anything else is null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY_RANK.items() for x in pair)), F.lower(severity))


def consumed(found: DataFrame, truth: DataFrame, tolerance: int = 2) -> DataFrame:
    """case_id, t, distance, severity_passed, high: each truth in turn takes a finding of its path within the tolerance that none before it took.

    found: case_id, path, line, rule_id, severity; of several at one place for one rule the highest severity counts. truth: case_id, t (their order), path, start,
    end (null or before the start: the start), rule_id (null or empty: any rule), min_severity (null: low). The nearest comes first, of these the most severe, then
    by line and rule. A truth's path, line and rule restrict it, so that cases are dealt out by path.
    """
    rank = severity_rank(F.col("severity"))
    best = found.groupBy("case_id", "path", "line", F.coalesce("rule_id", F.lit("")).alias("found_rule")).agg(F.max(rank).alias("rank"))
    best = best.withColumn("p", F.row_number().over(Window.partitionBy("case_id", "path").orderBy("line", "found_rule")).cast("long"))
    end = F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.col("start"))
    asked = truth.select("case_id", "path", F.col("t").cast("long").alias("t"), "start", end.alias("end"), F.trim(F.coalesce("rule_id", F.lit(""))).alias("rule"), F.coalesce(severity_rank(F.col("min_severity")), F.lit(1)).alias("least"))
    near = matching.edges(best, asked, ["case_id", "path"], tolerance, ("found_rule", "rule", "rank", "least")).where("rule = '' or rule = found_rule")
    near = near.withColumn("rank", F.coalesce("rank", F.lit(0)))
    took = matching.match(near, ["case_id", "path"], matching.nearest_matching, "rank")
    out = took.join(near, ["case_id", "path", "t", "p"])
    return out.select("case_id", "t", F.col("distance").cast("long").alias("distance"), (F.col("rank") >= F.col("least")).alias("severity_passed"), (F.col("least") >= SEVERITY_RANK["high"]).alias("high"))


def case_results(cases: DataFrame, found: DataFrame, truth: DataFrame, matched: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """A row for each case: split, COUNTS, clean_hit, execution_success, and with repairs: repair_attempted, repair_passed, a count for each tier, e2e_success.

    cases: case_id, split, failed. found: case_id, p, severity; truth: case_id, t, severity (what should be commented on); matched: case_id, t, p. repairs:
    case_id, t, tier. A failed case finds nothing and misses all; it is never clean. high_hits are high truths that were found, with whatever
    severity. A case succeeds end to end if all its truths were found and their repairs verified.
    """
    high = F.lower(F.col("severity")).isin(*HIGH)
    wanted = truth.groupBy("case_id").agg(F.count("*").alias("expected"), F.count_if(high).alias("high_total"))
    given = found.groupBy("case_id").agg(F.count("*").alias("predicted"))
    both = matched.join(truth.select("case_id", "t", F.lower("severity").alias("wanted")), ["case_id", "t"]).join(found.select("case_id", "p", F.lower("severity").alias("given")), ["case_id", "p"])
    hits = both.groupBy("case_id").agg(F.count("*").alias("tp"), F.count_if(F.col("wanted") == F.col("given")).alias("severity_hits"), F.count_if(F.col("wanted").isin(*HIGH)).alias("high_hits"))
    rows = cases.select("case_id", "split", F.coalesce("failed", F.lit(False)).alias("failed")).join(wanted, "case_id", "left").join(given, "case_id", "left").join(hits, "case_id", "left")
    if repairs is not None:
        tiers = [F.count_if(F.col("tier") == t).alias("repair_" + t.replace("-", "_")) for t in REPAIR_TIERS]
        rows = rows.join(repairs.groupBy("case_id").agg(F.count("*").alias("repair_attempted"), F.count_if(F.col("tier") == REPAIR_TIERS[0]).alias("repair_passed"), *tiers), "case_id", "left")
    rows = rows.na.fill(0)
    live = lambda c: F.when(F.col("failed"), F.lit(0)).otherwise(c).cast("long")
    tp, predicted = live(F.col("tp")), live(F.col("predicted"))
    out = rows.select(
        "case_id", "split", "expected", predicted.alias("predicted"), tp.alias("tp"), (predicted - tp).alias("fp"), (F.col("expected") - tp).alias("fn"), live(F.col("severity_hits")).alias("severity_hits"), "high_total", live(F.col("high_hits")).alias("high_hits"),
        (~F.col("failed") & (F.col("expected") == 0) & (F.col("predicted") == 0)).alias("clean_hit"), (~F.col("failed")).alias("execution_success"), *([live(F.col(c)).alias(c) for c in rows.columns if c.startswith("repair_")]),
    )
    if repairs is None:
        return out
    return out.withColumn("e2e_success", (F.col("expected") > 0) & (F.col("tp") == F.col("expected")) & (F.col("repair_attempted") == F.col("expected")) & (F.col("repair_passed") == F.col("expected")))


def repair_tier(checks: Column, passed: Column) -> Column:
    """The tier of a repair by its checks (array<name, passed>): first whether the risk was reproduced, then whether there is a patch, then whether it holds."""
    said = lambda name, value: F.exists(checks, lambda c: (c["name"] == name) & (F.coalesce(c["passed"], F.lit(False)) == value))
    no = F.lit(False)
    return (
        F.when(F.coalesce(said("risk-reproduction", False), no), "unreproduced").when(~F.coalesce(said("patch-generated", True), no), "suggestion-only")
        .when(F.coalesce(passed, no), "verified-draft").otherwise("blocked")
    )


def run_metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and rates of cases by keys; a rate without a denominator is null, and so are all of repairs and end-to-end where none were made."""
    repaired = "e2e_success" in results.columns
    sums = [*COUNTS[2:], *(c for c in results.columns if c.startswith("repair_"))]
    total = results.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(F.col("expected") > 0).alias("risk_cases"), F.count_if(F.col("expected") == 0).alias("clean_cases"), *(F.sum(c).alias(c) for c in sums),
        F.count_if("clean_hit").alias("clean_hits"), F.count_if("execution_success").alias("execution_successes"), *([F.count_if("e2e_success").alias("e2e_successes")] if repaired else []),
    )
    c = F.col
    rates = {
        "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "severity_accuracy": ratio(c("severity_hits"), c("tp")), "high_risk_recall": ratio(c("high_hits"), c("high_total")),
        "clean_accuracy": ratio(c("clean_hits"), c("clean_cases")), "execution_success_rate": ratio(c("execution_successes"), c("cases")),
    }
    if repaired:
        judged = c("repair_attempted") - c("repair_unreproduced")
        rates |= {"safe_fix_rate": ratio(c("repair_passed"), c("repair_attempted")), "verified_draft_rate": ratio(c("repair_verified_draft"), judged), "blocked_rate": ratio(c("repair_blocked"), judged), "suggestion_only_rate": ratio(c("repair_suggestion_only"), judged), "e2e_security_fix_rate": ratio(c("e2e_successes"), c("risk_cases"))}
    return total.withColumns(rates).withColumn("f1", f1_of_rounded(F.col("precision"), F.col("recall")))
