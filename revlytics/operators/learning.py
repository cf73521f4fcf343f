"""Literal rules learned from feedback: as it was said, or mined from what was missed; and rows deleted by notices instead of in place."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import GAP, strip
from revlytics.operators.scanners import RULE_ID

# Longest literal of a rule, and what feedback adds and takes away.
MOST_CHARS, MISSED, WRONG = 240, "missed_issue", "false_positive"


def learned_rules(rules: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules (rule_id, match, severity) after feedback in its order, and (at, rule_id, outcome): added, known, removed, nothing-to-remove or ignored.

    feedback: at (unique), category, rule_id, evidence, severity. A wrong finding removes all rules of its id that are there by then; a missed issue adds its evidence, if that is one line
    of at most MOST_CHARS, unless the rule has it. Rules of different ids don't touch, and of one id only the last removal and what came since counts, so no row is read in turn.
    """
    rule, text = F.upper(strip(F.coalesce("rule_id", F.lit("")))), strip(F.coalesce("evidence", F.lit("")))
    usable = rule.rlike(f"^{RULE_ID}$")
    adds = usable & (F.col("category") == MISSED) & (text != "") & (F.length(text) <= MOST_CHARS) & ~text.rlike("[\r\n]")
    rows = feedback.withColumns({"rule_id": rule, "match": text}).withColumn("kind", F.when(adds, "add").when(usable & (F.col("category") == WRONG), "remove"))
    # Spans between the removals of a rule id; the rules that were there before belong to the first.
    there = rules.select(F.lit(None).cast(feedback.schema["at"].dataType).alias("at"), "rule_id", "match", "severity", F.lit("add").alias("kind"))
    said = rows.where("kind is not null").select("at", "rule_id", "match", F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"), "kind")
    order = Window.partitionBy("rule_id").orderBy(F.col("at").asc_nulls_first())
    spans = there.unionByName(said).withColumn("span", F.count_if(F.col("kind") == "remove").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = Window.partitionBy("rule_id", F.when(F.col("kind") == "remove", F.col("span") - 1).otherwise(F.col("span")))
    spans = spans.withColumn("any", F.count_if(F.col("kind") == "add").over(held) > 0)
    first = F.row_number().over(Window.partitionBy("rule_id", "span", "kind", "match").orderBy(F.col("at").asc_nulls_first()))
    spans = spans.withColumn("first", first).withColumn("last", F.max("span").over(Window.partitionBy("rule_id")))
    after = spans.where("kind = 'add' and first = 1 and span = last").select("rule_id", "match", "severity")
    outcome = F.when(F.col("kind") == "remove", F.when(F.col("any"), "removed").otherwise("nothing-to-remove")).when(F.col("first") == 1, "added").otherwise("known")
    told = spans.where("at is not null").select("at", "rule_id", outcome.alias("outcome"))
    return after, told.unionByName(rows.where("kind is null").select("at", "rule_id", F.lit("ignored").alias("outcome")))


def _phrases(lines: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """keys, phrase: each run of up to `longest` words of a line, once."""
    words = F.filter(F.split(F.coalesce("content", F.lit("")), GAP, -1), lambda w: w != "")
    rows = lines.select(*keys, words.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(
        F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    return rows.select(*keys, F.explode(F.array_distinct(runs)).alias("phrase"))


def mined_literals(missed: DataFrame, clean: DataFrame, least: int = 3, most_clean: int = 0, longest: int = 4) -> DataFrame:
    """rule_id, match, support, clean: phrases of up to `longest` words that at least `least` missed lines of a rule share and at most `most_clean` clean lines have.

    missed: rule_id, content; clean: content. Phrases are joined by single blanks; a line counts a phrase once. Of phrases of one rule with one support, those within a longer one with
    the same support are left out: the longer says more. Phrases of clean lines are counted only where a candidate has them.
    """
    own = _phrases(missed, ["rule_id"], longest).where(F.length("phrase") <= MOST_CHARS).groupBy("rule_id", "phrase").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    wanted = own.select("phrase").distinct()
    counts = _phrases(clean, [], longest).join(wanted, "phrase", "left_semi").groupBy("phrase").agg(F.count("*").alias("clean"))
    kept = own.join(counts, "phrase", "left").na.fill(0, ["clean"]).where(F.col("clean") <= most_clean)
    # A phrase's parts are shorter by a word at either end; dropping them step by step leaves the longest.
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " ")))
    parts = kept.where(F.size(words) > 1).select("rule_id", "support", inner.alias("phrase")).distinct()
    return kept.join(parts, ["rule_id", "support", "phrase"], "left_anti").select("rule_id", F.col("phrase").alias("match"), "support", "clean")


def without_deleted(rows: DataFrame, notices: DataFrame, keys: list[str], now: Column | None = None) -> DataFrame:
    """rows (keys, created, perhaps expires) that no later notice deletes: notices have `at` and each key, null for any; one that names no key is an error.

    Notices are counted as a table of the latest for each set of keys that they name, so that a join for each set is enough: 2^keys - 1 of them. With `now`, expired rows go too;
    nothing is removed from the tables, so an earlier state is the same view over earlier notices.
    """
    named = F.lit(False)
    for k in keys:
        named = named | F.col(k).isNotNull()
    if not notices.where(~named).isEmpty():
        raise ValueError("a deletion must name a key")
    out = rows
    for n in range(1, len(keys) + 1):
        for some in combinations(keys, n):
            test = F.lit(True)
            for k in keys:
                test = test & (F.col(k).isNotNull() if k in some else F.col(k).isNull())
            last = notices.where(test).groupBy(*some).agg(F.max("at").alias("_at"))
            out = out.join(last, list(some), "left").where(F.col("_at").isNull() | (F.col("created") > F.col("_at"))).drop("_at")
    if now is not None:
        out = out.where(F.col("expires").isNull() | (F.col("expires") > now))
    return out.select(*rows.columns)
