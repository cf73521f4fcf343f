"""Replays of a prompt scored, two of them compared, and the decision on a candidate with all its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.functions.metrics import non_regressing, ratio, wilson

# Weights of a replay's score, metrics that must not fall (the last two only where their cases exist), and those that have an interval.
WEIGHTS = {"f1": 0.65, "severity_accuracy": 0.15, "clean_accuracy": 0.20}
PROTECTED = ("score", "precision", "recall", "high_severity_recall", "severity_accuracy", "clean_accuracy")
INTERVALS = ("precision", "recall", "high_severity_recall", "severity_accuracy", "clean_accuracy")


def replay_metrics(cases: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each replay: score, its parts, their intervals and counts. A rate without a denominator is null; a replay without any part scores 0.

    cases: expected, tp, fp, fn, severity_hits, high_total, high_hits, ok. A failed case (not ok) misses what was expected, and is never a clean hit. The score is the weighted mean of the parts that are
    defined, unrounded, times the share of cases that ended.
    """
    c = F.col
    clean = c("expected") == 0
    total = cases.groupBy(*keys).agg(
        *(F.sum(x).alias(x) for x in ("tp", "fp", "fn", "severity_hits", "high_total", "high_hits", "expected")), F.count("*").alias("cases"), F.count_if(~clean).alias("positive_cases"), F.count_if(clean).alias("clean_cases"),
        F.count_if(clean & c("ok") & (c("tp") + c("fp") == 0)).alias("clean_hits"), F.count_if("ok").alias("ok"),
    )
    exact = lambda n, d: F.try_divide(n.cast("double"), d.cast("double"))
    rates = {
        "precision": (c("tp"), c("tp") + c("fp")), "recall": (c("tp"), c("tp") + c("fn")), "f1": (2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), "severity_accuracy": (c("severity_hits"), c("tp")),
        "clean_accuracy": (c("clean_hits"), c("clean_cases")), "high_severity_recall": (c("high_hits"), c("high_total")),
    }
    counts = {"f1": c("expected") > 0, "severity_accuracy": c("expected") > 0, "clean_accuracy": c("clean_cases") > 0}
    part = {n: F.when(counts[n], exact(*rates[n])) for n in WEIGHTS}
    top = sum((F.coalesce(part[n] * w, F.lit(0.0)) for n, w in WEIGHTS.items()), F.lit(0.0))
    under = sum((F.when(part[n].isNull(), 0.0).otherwise(w) for n, w in WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.coalesce(F.try_divide(top, under), F.lit(0.0)) * F.coalesce(exact(c("ok"), c("cases")), F.lit(0.0)), 4)
    return total.withColumns(
        {"score": score, "success_rate": F.coalesce(ratio(c("ok"), c("cases")), F.lit(0.0)), "errors": c("cases") - c("ok"), "matched": c("tp")} | {n: ratio(*x) for n, x in rates.items()}
        | {f"{n}_{end}": wilson(rates[n][0], rates[n][1], end == "high") for n in INTERVALS for end in ("low", "high")}
    )


def regression(candidate: str, baseline: str, margin: float) -> Column:
    """passed, regressed, unmeasurable of two structs of `replay_metrics`, names sorted.

    A metric that the baseline lacks can't fall, and is told as unmeasurable; one that only the candidate lacks has fallen. severity_accuracy counts where the baseline has positive cases, clean_accuracy where it has
    clean ones. Where the two matched different numbers, severity_accuracy is judged by hits, and told as unmeasurable: its denominator is what the candidate earned.
    """
    c, b = (lambda n: F.col(f"{candidate}.{n}")), (lambda n: F.col(f"{baseline}.{n}"))
    counts = {"severity_accuracy": F.coalesce(b("positive_cases") > 0, F.lit(False)), "clean_accuracy": F.coalesce(b("clean_cases") > 0, F.lit(False))}
    other = F.coalesce(b("matched") != c("matched"), F.lit(False))
    holds = {n: non_regressing(c(n), b(n), margin) for n in PROTECTED}
    holds["severity_accuracy"] = F.when(other, F.coalesce(c("severity_hits"), F.lit(0)) >= F.coalesce(b("severity_hits"), F.lit(0))).otherwise(holds["severity_accuracy"])
    here = lambda n: counts.get(n, F.lit(True))
    named = lambda tests: F.array_sort(F.array_compact(F.array(*(F.when(here(n) & t, F.lit(n)) for n, t in tests.items()))))
    fell = named({n: ~h for n, h in holds.items()})
    unknown = named({n: (b(n).isNull() | other) if n == "severity_accuracy" else b(n).isNull() for n in PROTECTED})
    return F.struct((F.size(fell) == 0).alias("passed"), fell.alias("regressed"), unknown.alias("unmeasurable"))


def significant(candidate: str, baseline: str) -> Column:
    """Whether any metric's intervals are apart; null if none can be compared."""
    apart = []
    for n in INTERVALS:
        low, high = (lambda x: F.col(f"{x}.{n}_low")), (lambda x: F.col(f"{x}.{n}_high"))
        apart.append((low(candidate) > high(baseline)) | (low(baseline) > high(candidate)))
    known = F.array_compact(F.array(*apart))
    return F.when(F.size(known) > 0, F.exists(known, lambda x: x))


def decided(pairs: DataFrame, safe: Column, ready: Column, holdout_ready: Column, automatic: Column, least_gain: float, margin: float) -> DataFrame:
    """pairs (structs c, b, ch, bh of `replay_metrics`: candidate and baseline on validation and holdout) with decision, reasons and gates.

    An unsafe candidate is rejected without being measured; one without enough cases is deferred. Else it is rejected with every reason, or goes on: activated if `automatic`, else shadow_ready.
    """
    rows = pairs.withColumns({"validation": regression("c", "b", margin), "holdout": regression("ch", "bh", margin)})
    errors = sum((F.coalesce(F.col(f"{x}.errors"), F.lit(0)) for x in ("c", "b", "ch", "bh")), F.lit(0))
    improved = F.coalesce(F.col("c.score") >= F.col("b.score") + least_gain, F.lit(False))
    fell = lambda where: F.concat(F.lit(f"a protected {where} metric regressed ("), F.array_join(f"{where}.regressed", ", "), F.lit(")"))
    why = F.array_compact(F.array(
        F.when(errors > 0, "one or more evaluations failed"), F.when(~improved, "score improvement was below the threshold"), F.when(~F.col("validation.passed"), fell("validation")), F.when(~F.col("holdout.passed"), fell("holdout")),
    ))
    early = F.when(~safe, "unsafe or incomplete prompt").when(~ready, "too few validation cases").when(~holdout_ready, "too few holdout cases")
    decision = F.when(~safe, "rejected").when(early.isNotNull(), "deferred").when(F.size(why) > 0, "rejected").when(automatic, "activated").otherwise("shadow_ready")
    measured = early.isNull()
    return rows.withColumns({
        "decision": decision, "reasons": F.when(early.isNotNull(), F.array(early)).otherwise(why), "evaluation_success": F.when(measured, errors == 0), "improvement": F.when(measured, improved),
        "validation_kept": F.when(measured, F.col("validation.passed")), "holdout_kept": F.when(measured, F.col("holdout.passed")), "significant": F.when(measured, significant("c", "b")), "holdout_significant": F.when(measured, significant("ch", "bh")),
    })


def may_activate(versions: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """versions (keys, version, active) with allowed: active already, or a run of the same keys made it a candidate and activated it."""
    good = runs.where("decision = 'activated'").select(*keys, F.col("candidate_version").alias("version")).distinct().withColumn("_ran", F.lit(True))
    out = versions.join(good, [*keys, "version"], "left")
    return out.withColumn("allowed", F.coalesce("active", F.lit(False)) | F.col("_ran").isNotNull()).drop("_ran")


def paired(a: DataFrame, b: DataFrame, keys: list[str], id_col: str, value: str) -> DataFrame:
    """keys, id, a, b of two arms with the same ids; an id that only one arm has, or that comes twice in one, ends the job: unequal arms can't be compared."""
    side = lambda df, name: df.groupBy(*keys, id_col).agg(F.count("*").alias(f"_{name}"), F.first(value).alias(name))
    both = side(a, "a").join(side(b, "b"), [*keys, id_col], "full")
    fits = (F.coalesce("_a", F.lit(0)) == 1) & (F.coalesce("_b", F.lit(0)) == 1)
    wrong = F.raise_error(F.concat(F.lit("arms differ at "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return both.select(*keys, F.when(fits, F.col(id_col)).otherwise(wrong.cast(a.schema[id_col].dataType)).alias(id_col), "a", "b")
