"""Labels of people and judges: stable ids, scopes, verdicts brought into their domains, answers aligned with what was asked, and how steady they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.functions.metrics import ratio
from revlytics.functions.review import SEVERITY_RANK
from revlytics.functions.strings import strip
from revlytics.operators import matching

# Classes that a verdict may name, weaknesses that mean none, and the lines by which a place may miss a label.
VERDICT_CLASSES = (
    "crypto-weak", "injection", "secret-exposure", "path-traversal", "concurrency", "resource-leak", "auth-bypass", "logic-boundary",
    "input-validation", "contract-type", "state-machine", "encoding-escaping", "error-handling", "api-misuse", "no-defect",
)
NO_WEAKNESS = ("", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "CWE-0", "CWE-000", "CWE-NONE")
SCOPE_LINES, BASIS_CHARS = 2, 1000


def label_path(path: Column) -> Column:
    """A path as labels compare it: forward slashes, and without any a, b or slash at its start (so `apps/x` is `pps/x`, on both sides)."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[ab/]+", "")


def weakness(raw: Column) -> Column:
    """An id in capitals; empty for placeholders and null."""
    value = F.upper(strip(F.coalesce(raw, F.lit(""))))
    return F.when(value.isin(*NO_WEAKNESS), "").otherwise(value)


def finding_id(case: Column, path: Column, line: Column) -> Column:
    return F.concat_ws("|", case, F.replace(path, F.lit("\\"), F.lit("/")), line.cast("string"))


def alert_id(case: Column, path: Column, line: Column, rule: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", case, F.replace(path, F.lit("\\"), F.lit("/")), line.cast("string"), rule).cast("binary")), 1, 16)


def verdict(severity: Column, defect_class: Column, cwe: Column, confidence: Column, basis: Column) -> Column:
    """severity, defect_class (null where not in their domain), cwe, confidence (0 to 1, three digits), basis, invalid_fields: what wasn't right, with its raw value.

    confidence is text; a missing one is 0 and not invalid, one that isn't a number is 0 and invalid.
    """
    plain = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    parsed = strip(confidence).try_cast("double")
    right = {"severity": plain(severity).isin(*SEVERITY_RANK), "defect_class": plain(defect_class).isin(*VERDICT_CLASSES), "confidence": confidence.isNull() | parsed.isNotNull()}
    raw = {"severity": severity, "defect_class": defect_class, "confidence": confidence}
    wrong = F.array_compact(F.array(*(F.when(~ok, F.concat(F.lit(f"{n}="), F.coalesce(raw[n], F.lit("null")))) for n, ok in right.items())))
    return F.struct(
        F.when(right["severity"], plain(severity)).alias("severity"), F.when(right["defect_class"], plain(defect_class)).alias("defect_class"), weakness(cwe).alias("cwe"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed, F.lit(0.0)))), 3).alias("confidence"), F.substring(F.coalesce(basis, F.lit("")), 1, BASIS_CHARS).alias("basis"), wrong.alias("invalid_fields"),
    )


def scoped(findings: DataFrame, truth: DataFrame, case: str, key: str, tolerance: int = SCOPE_LINES) -> DataFrame:
    """findings (case, key (unique in a case), path, line) with in_label_scope: whether a label's lines, widened by the tolerance, hold theirs on the same path."""
    spot = findings.select(case, label_path(F.col("path")).alias("_path"), F.col(key).alias("p"), "line")
    labels = truth.select(case, label_path(F.col("path")).alias("_path"), F.lit(0).cast("long").alias("t"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    near = matching.edges(spot, labels, [case, "_path"], tolerance).select(case, F.col("p").alias(key)).distinct().withColumn("_in", F.lit(True))
    return findings.join(near, [case, key], "left").withColumn("in_label_scope", F.coalesce("_in", F.lit(False))).drop("_in")


def answered(asked: DataFrame, case: str, expected: str, verdicts: str, error: str) -> DataFrame:
    """case, place (from 0), item, verdict, state of everything that was asked: its answer by position. A short answer leaves missing-verdict, a failed case error; what there is more of is left."""
    rows = asked.select(case, F.posexplode(expected).alias("place", "item"), F.col(verdicts).alias("_v"), F.col(error).alias("_e"))
    one = F.when(F.col("_e").isNull(), F.get("_v", F.col("place")))
    state = F.when(F.col("_e").isNotNull(), "error").when(F.get("_v", F.col("place")).isNull(), "missing-verdict").otherwise("answered")
    return rows.select(case, "place", "item", one.alias("verdict"), state.alias("state"))


def steadiness(first: DataFrame, second: DataFrame, asked: DataFrame, case: str) -> DataFrame:
    """case, candidates, agreement (null without candidates), flipped: whether two passes over the same candidates in another order accept the same ones.

    asked: case, candidates; passes: case, place, accepted; a place that a pass lacks isn't accepted there.
    """
    both = first.select(case, "place", F.col("accepted").alias("a")).join(second.select(case, "place", F.col("accepted").alias("b")), [case, "place"], "full")
    no = F.lit(False)
    flips = both.where(F.coalesce("a", no) != F.coalesce("b", no)).join(asked, case).where("place >= 0 and place < candidates").groupBy(case).agg(F.sort_array(F.collect_list("place")).alias("flipped"))
    rows = asked.join(flips, case, "left").withColumn("flipped", F.coalesce("flipped", F.array().cast("array<int>")))
    return rows.select(case, "candidates", ratio(F.col("candidates") - F.size("flipped"), F.col("candidates")).alias("agreement"), "flipped")
