"""Review rules as Columns: paths, severities, gates with all their reasons, ordered verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlytics.functions.strings import strip

# Severities by rank, tools whose evidence is strong, and thresholds.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
STRONG_TOOLS = ("ast_analyze", "symbol", "git_context", "run_scanners", "semgrep", "bandit", "eslint", "typecheck", "test", "diff-ast-analyze")
LEAST_CONFIDENCE, LEAST_KAPPA, LEAST_AGREEMENT = 0.55, 0.6, 0.85


def match_path(path: Column) -> Column:
    """Slashes forward, one a/ or b/ stripped."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^[ab]/", "")


def tool_path(path: Column) -> Column:
    """Slashes forward, then ./, a/ and b/ stripped in this order, each once."""
    out = F.translate(path, "\\", "/")
    for head in ("[.]/", "a/", "b/"):
        out = F.regexp_replace(out, "^" + head, "")
    return out


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.lower(severity) == name, rank) if out is None else out.when(F.lower(severity) == name, rank)
    return out.otherwise(0).cast("long")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of all checks that hold, in order; null counts as not."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def gate_reasons(f: dict[str, Column]) -> Column:
    """Why a finding isn't let through, all reasons: place and fields, evidence, strong evidence of high risks, confidence, fix and test of high risks.

    `f`: line (content of the added line, null where the place isn't one), rule_id, title, explanation, evidence, tools (those with an evidence id),
    chain (whether there is a call chain), severity, confidence, fix, test.
    """
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    high = F.lower(f["severity"]).isin("critical", "high")
    quoted = ~blank(f["evidence"]) & F.coalesce(F.contains(strip(f["line"]), strip(f["evidence"])), F.lit(False))
    strong = F.exists(f["tools"], lambda t: t.isin(*STRONG_TOOLS))
    return reasons({
        "format": f["line"].isNull() | blank(f["rule_id"]) | blank(f["title"]) | blank(f["explanation"]),
        "evidence": ~quoted & (F.size(f["tools"]) == 0) & ~f["chain"],
        "strong-evidence": high & ~strong & ~f["chain"],
        "confidence": f["confidence"] < LEAST_CONFIDENCE,
        "release": high & (blank(f["fix"]) | blank(f["test"])),
    })


def disjoint(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two intervals don't meet; null where one is unmeasurable."""
    return (low > other_high) | (other_low > high)


def severity_verdict(c_matched: Column, b_matched: Column, c_hits: Column, b_hits: Column, c_rate: Column, b_rate: Column, margin: float) -> Column:
    """Ratios are compared only over equal denominators, else hits."""
    rates = b_rate.isNull() | F.coalesce(c_rate + F.lit(margin) >= b_rate, F.lit(False))
    return F.when(c_matched.isNull() | b_matched.isNull() | (c_matched == b_matched), rates).otherwise(F.coalesce(c_hits, F.lit(0)) >= F.coalesce(b_hits, F.lit(0)))


def calibrated(kappa: Column, agreement: Column) -> Column:
    """A judge is calibrated; null where either figure is unmeasurable."""
    return F.when(kappa.isNotNull() & agreement.isNotNull(), (kappa >= LEAST_KAPPA) & (agreement >= LEAST_AGREEMENT))


def case_score(tp: Column, fp: Column, fn: Column, failed: Column) -> Column:
    """2tp / (2tp + fp + fn): null for a failed case, 1 where nothing was expected or found."""
    return F.when(~failed, F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(F.round(2.0 * tp / (2 * tp + fp + fn), 4)))
