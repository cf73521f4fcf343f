"""Whether a corpus and a prompt are ready, which gates fail, and what a run in production cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.functions.metrics import ratio
from revlytics.functions.strings import once, strip

# Kinds of real sources, splits, terms that a prompt must have and phrases that it mustn't, and its greatest length.
REAL_SOURCES = ("public-github-pr", "private-historical-pr")
SPLITS = ("train", "validation", "holdout")
REQUIRED_TERMS = ("diff", "severity", "fix", "test", "json")
FORBIDDEN_PHRASES = (
    "ignore previous", "ignore all previous", "disregard previous", "disable safety", "bypass safety", "bypass the safety", "bypass review", "bypass the review", "bypass validation", "bypass the gate", "直接执行生产",
)
PROMPT_CHARS = 12_000


def readiness(corpus: DataFrame, least: int = 300) -> DataFrame:
    """One row over cases (repository, split, kind): cases, repositories, a boolean for each gate, overlaps, and ready. Splits of a repository are a set of three at most.

    An unknown split is an error of the corpus and fails `known_splits`. A null repository is the empty one, a null kind `unknown`.
    """
    rows = corpus.select(F.coalesce("repository", F.lit("")).alias("repository"), "split", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    sides = rows.groupBy("repository").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"), F.bool_and(F.col("kind").isin(*REAL_SOURCES)).alias("real"), F.bool_and(F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).alias("known"))
    has = lambda s: F.coalesce(F.bool_or(F.array_contains("splits", s)), F.lit(False))
    cases = F.coalesce(F.sum("n"), F.lit(0))
    total = sides.agg(
        cases.alias("cases"), F.count("*").alias("repositories"), F.count_if(F.size("splits") > 1).alias("overlaps"), (cases >= least).alias("minimum_cases"), F.coalesce(F.bool_and("real"), F.lit(False)).alias("real_provenance"),
        (F.count_if(F.size("splits") > 1) == 0).alias("repository_isolation"), *(has(s).alias(f"{s}_present") for s in SPLITS), F.coalesce(F.bool_and("known"), F.lit(True)).alias("known_splits"),
    )
    gates = ["minimum_cases", "real_provenance", "repository_isolation", *(f"{s}_present" for s in SPLITS), "known_splits"]
    ready = F.lit(True)
    for g in gates:
        ready = ready & F.col(g)
    return total.withColumn("ready", ready)


def prompt_safety(prompt: Column) -> Column:
    """safe, completeness, missing_terms, forbidden, empty, too_long, length of a prompt, outer white space aside; null is empty."""
    return once(strip(F.coalesce(prompt, F.lit(""))), lambda plain: once(F.lower(plain), lambda low: _safety(plain, low)))


def _safety(plain: Column, low: Column) -> Column:
    held = lambda words, want: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)) == want, F.lit(w)) for w in words)))
    forbidden, missing = held(FORBIDDEN_PHRASES, True), held(REQUIRED_TERMS, False)
    empty, long_ = plain == "", F.length(plain) > PROMPT_CHARS
    share = F.round((F.lit(len(REQUIRED_TERMS)) - F.size(missing)) / len(REQUIRED_TERMS), 4)
    return F.struct((~empty & ~long_ & (F.size(forbidden) == 0)).alias("safe"), share.alias("completeness"), missing.alias("missing_terms"), forbidden.alias("forbidden"), empty.alias("empty"), long_.alias("too_long"), F.length(plain).alias("length"))


def failing_gates(gates: Column, known: tuple[str, ...]) -> Column:
    """Names of a map's gates that are false, of those that count as gates, in order: null isn't a failure here, and other booleans aren't gates."""
    return F.array_sort(F.map_keys(F.map_filter(gates, lambda k, v: k.isin(*known) & ~F.coalesce(v, F.lit(True)))))


def surely_positive(low: Column) -> Column:
    """A confidence interval's lower end is above 0; no interval is no significance."""
    return F.coalesce(low > 0, F.lit(False))


TIERS = ("location", "category", "cwe-exact")


def production_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and averages by keys of cases in production; null where the denominator is 0.

    cases: tp, ok, invalid_comments, exact_location_hits, evidence_hits, accepted_comments, closed_comments, latency_ms, cost_usd, llm_calls, input_tokens, output_tokens, total_tokens, tier_tp, tier_fn: maps from TIERS.
    Cost is summed in whole microdollars of each case.
    """
    counts = ("invalid_comments", "exact_location_hits", "evidence_hits", "accepted_comments", "closed_comments", "latency_ms", "llm_calls", "input_tokens", "output_tokens", "total_tokens")
    tier = lambda m, t: F.sum(F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0))).cast("long")
    total = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.sum("tp").alias("tp"), F.count_if("ok").alias("ok"), *(F.sum(c).alias(c) for c in counts), F.sum(F.coalesce(F.col("cost_usd") * 1_000_000, F.lit(0)).cast("long")).alias("cost_microusd"),
        *(tier(f"tier_{x}", t).alias(f"{t.replace('-', '_')}_{x}") for t in TIERS for x in ("tp", "fn")),
    )
    c = F.col
    per = lambda n, digits=4: ratio(n, c("cases"), digits)
    rates = {
        "invalid_comments_per_pr": per(c("invalid_comments")), "exact_line_accuracy": ratio(c("exact_location_hits"), c("tp")), "evidence_accuracy": ratio(c("evidence_hits"), c("tp")),
        "comment_acceptance_rate": ratio(c("accepted_comments"), c("accepted_comments") + c("closed_comments")), "average_cost_usd_per_pr": per(c("cost_microusd") / 1_000_000, 8), "average_latency_ms_per_pr": per(c("latency_ms"), 2),
        "average_llm_calls_per_pr": per(c("llm_calls")), "average_total_tokens_per_pr": per(c("total_tokens"), 2), "failure_rate": F.round(1 - F.try_divide(c("ok").cast("double"), c("cases").cast("double")), 4),
    }
    recalls = {f"{t.replace('-', '_')}_recall": ratio(c(f"{t.replace('-', '_')}_tp"), c(f"{t.replace('-', '_')}_tp") + c(f"{t.replace('-', '_')}_fn")) for t in TIERS}
    return total.withColumns(rates | recalls)


def activity(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tools (distinct, sorted), tool_calls, failed_tool_calls, steps, stopped_early of traced agents. events: event, tool, ok, step."""
    seen = F.col("event") == "tool_observation"
    return events.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(seen & (F.coalesce("tool", F.lit("")) != ""), F.col("tool")))).alias("tools"), F.count_if(seen & (F.coalesce("tool", F.lit("")) != "")).alias("tool_calls"), F.count_if(seen & ~F.coalesce("ok", F.lit(False))).alias("failed_tool_calls"),
        F.coalesce(F.max(F.greatest("step", F.lit(0))), F.lit(0)).alias("steps"), F.coalesce(F.bool_or(F.col("event") == "budget_exhausted"), F.lit(False)).alias("stopped_early"),
    )


def role_calls(cases: DataFrame, keys: list[str], roles: str) -> DataFrame:
    """keys, role, calls: a map column's counts by role, summed over cases."""
    return cases.select(*keys, F.explode(roles).alias("role", "n")).groupBy(*keys, "role").agg(F.sum("n").alias("calls"))
