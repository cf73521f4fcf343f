"""Prompts with learned rules: read as tables, compared, changed by logs of operations, and written again.

A log is one transaction of a case: if any of its operations isn't well-formed, none is applied. Else each rule has one operation, so that
a log meets the rules in one full outer join, whatever the number of rules. Operations that don't suit the rules (adding what is there, replacing
or dropping what isn't) are rejected one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip
from revlytics.operators.diffs import lines_of
from revlytics.operators.scanners import RULE_ID

# What opens the block of learned rules, and how a rule and its origin are marked.
HEADER = "Learned constraints:"
_MARK = rf"\[focus-rule:({RULE_ID})\]"
_ORIGIN = r"(?U)\s*\[(?:src|gates):[^\]]*\]"
OPERATIONS = ("add", "replace", "drop")
_NONE = "array<string>"


def without_origin(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), _ORIGIN, ""))


def rule_ids(prompt: Column) -> Column:
    """Marked rules, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(_MARK), F.lit(1))))


def learned(prompts: DataFrame, case: str, prompt: str) -> DataFrame:
    """case, at, item of each learned constraint, without its origin: lines `- ...` after the header, up to a line of another kind. One prompt a case."""
    rows = prompts.select(case, F.posexplode(lines_of(F.col(prompt))).alias("at", "raw")).select(case, "at", strip(F.col("raw")).alias("raw"))
    raw = F.col("raw")
    is_item = raw.startswith("- ")
    opens = F.when(raw == HEADER, F.lit(True)).when((raw != "") & ~is_item, F.lit(False))
    so_far = Window.partitionBy(case).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.last(opens, True).over(so_far), F.lit(False))
    return rows.withColumn("inside", inside).where(F.col("inside") & is_item).select(case, "at", without_origin(F.substr(raw, F.lit(3))).alias("item"))


def inventory(prompts: DataFrame, case: str, prompt: str) -> DataFrame:
    """case, rule_ids, constraints (in order)."""
    items = learned(prompts, case, prompt).groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("constraints"))
    return prompts.select(case, rule_ids(F.col(prompt)).alias("rule_ids")).join(items, case, "left").withColumn("constraints", F.coalesce("constraints", F.array().cast(_NONE)))


def retention(pairs: DataFrame, case: str, baseline: str, candidate: str, allowed: Column | None = None) -> DataFrame:
    """case, passed, undeclared, declared, dropped_rule_ids, added_rule_ids, dropped_constraints: whether a candidate keeps the baseline's rules.

    passed is null if the baseline has no marked rule (not a pass), false if one is gone that isn't allowed to go. Constraints are compared by their text, in
    the baseline's order.
    """
    before, after = inventory(pairs, case, baseline), inventory(pairs, case, candidate)
    both = before.select(case, F.col("rule_ids").alias("b"), F.col("constraints").alias("bc")).join(after.select(case, F.col("rule_ids").alias("c"), F.col("constraints").alias("cc")), case)
    both = both.join(pairs.select(case, F.coalesce(allowed if allowed is not None else F.lit(None).cast(_NONE), F.array().cast(_NONE)).alias("ok")), case)
    gone = F.array_except("b", "c")
    both = both.withColumns({"gone": gone, "undeclared": F.array_except(gone, "ok")})
    return both.select(
        case, F.when(F.size("b") > 0, F.size("undeclared") == 0).alias("passed"), "undeclared", F.array_sort(F.array_intersect("gone", "ok")).alias("declared"), F.col("gone").alias("dropped_rule_ids"),
        F.array_except("c", "b").alias("added_rule_ids"), F.filter("bc", lambda x: ~F.array_contains("cc", x)).alias("dropped_constraints"),
    )


def entries_of(prompts: DataFrame, case: str, prompt: str) -> tuple[DataFrame, DataFrame]:
    """(case, rule_id, text, run_id, gates) of marked constraints, and (case, body, unstructured) of the rest: the text above the first header, and constraints without a mark in order."""
    items = learned(prompts, case, prompt).withColumn("rule_id", F.regexp_extract("item", _MARK, 1))
    marked = items.where("rule_id <> ''").select(case, "rule_id", F.col("item").alias("text"), F.lit("").alias("run_id"), F.array().cast(_NONE).alias("gates"))
    loose = items.where("rule_id = ''").groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("unstructured"))
    text = F.coalesce(F.col(prompt), F.lit(""))
    below = F.substring_index(text, "\n" + HEADER, 1)
    head = F.when(strip(below) == strip(text), F.substring_index(text, HEADER, 1)).otherwise(below)
    rest = prompts.select(case, F.regexp_replace(head, r"(?U)[\s\x1c-\x1f]+\z", "").alias("body")).join(loose, case, "left")
    return marked, rest.withColumn("unstructured", F.coalesce("unstructured", F.array().cast(_NONE)))


def composed(bodies: DataFrame, entries: DataFrame, case: str) -> DataFrame:
    """case, prompt: the body, then one block with the unstructured constraints in their order and the rules by id, with their origin."""
    text = strip(F.col("text"))
    mark = F.concat(F.lit("[focus-rule:"), F.col("rule_id"), F.lit("]"))
    line = F.when(F.contains(text, mark), text).otherwise(F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(" "), mark, F.lit(".")))
    line = F.concat(line, F.when(F.coalesce("run_id", F.lit("")) != "", F.concat(F.lit(" [src:"), F.col("run_id"), F.lit("]"))).otherwise(""), F.when(F.size("gates") > 0, F.concat(F.lit(" [gates:"), F.array_join("gates", ","), F.lit("]"))).otherwise(""))
    rules = entries.groupBy(case).agg(F.transform(F.sort_array(F.collect_list(F.struct("rule_id", line.alias("line")))), lambda x: x["line"]).alias("rules"))
    rows = bodies.join(rules, case, "left")
    loose = F.filter(F.transform(F.coalesce("unstructured", F.array().cast(_NONE)), lambda x: strip(x)), lambda x: x != "")
    lines = F.concat(loose, F.coalesce("rules", F.array().cast(_NONE)))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)[\s\x1c-\x1f]+\z", "")
    return rows.select(case, F.when(F.size(lines) == 0, body).otherwise(F.concat(body, F.lit(f"\n\n{HEADER}\n- "), F.array_join(lines, "\n- "))).alias("prompt"))


def judged_log(log: DataFrame, case: str) -> DataFrame:
    """log (case, at, op, rule_id, text, run_id, gates, reason) with problems, an array, and voided: whether any operation of the case has one."""
    rule = strip(F.coalesce("rule_id", F.lit("")))
    formed = rule.rlike(f"^{RULE_ID}$")
    rows = log.withColumns({"rule_id": rule, "formed": formed})
    earlier = Window.partitionBy(case, "rule_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    problems = F.array_compact(F.array(
        F.when(~known, "unknown operation"), F.when(~F.col("formed"), "not a rule id"), F.when(F.col("formed") & (F.count("*").over(earlier) > 0), "rule more than once"),
        F.when(F.col("op").isin("add", "replace") & (without_origin(F.col("text")) == ""), "no text"), F.when((F.col("op") == "drop") & blank("reason"), "no reason"),
    ))
    rows = rows.withColumn("problems", problems)
    return rows.withColumn("voided", F.max(F.size("problems") > 0).over(Window.partitionBy(case))).drop("formed")


def apply_log(entries: DataFrame, log: DataFrame, case: str) -> tuple[DataFrame, DataFrame]:
    """The rules after each case's log, and its outcomes.

    entries: case, rule_id, text, run_id, gates, a rule once a case. First result: the same columns. Second: case, at, op, rule_id, outcome (applied, rejected,
    problem, voided), problems, and the text of a dropped rule. Replacing keeps origin and gates where the operation names none. Cases without a log stay as they are.
    """
    rows = judged_log(log, case)
    live = rows.where("not voided").select(case, "rule_id", F.struct("at", "op", "text", "run_id", "gates").alias("o"))
    held = entries.select(case, "rule_id", F.struct("text", "run_id", "gates").alias("e"))
    both = held.join(live, [case, "rule_id"], "full")
    here, op = F.col("e").isNotNull(), F.col("o.op")
    suits = F.when(op == "add", ~here).otherwise(here)
    both = both.withColumn("done", F.when(F.col("o").isNotNull(), suits))
    given = lambda c: F.when(F.coalesce(F.col(f"o.{c}"), F.lit("")) != "", F.col(f"o.{c}"))
    gates = F.when(F.coalesce(F.size("o.gates"), F.lit(0)) > 0, F.array_sort("o.gates"))
    writes = F.col("done") & op.isin("add", "replace")
    after = both.where(here & ~F.coalesce(F.col("done") & (op == "drop"), F.lit(False)) | F.coalesce(writes, F.lit(False))).select(
        case, "rule_id", F.when(writes, without_origin(F.col("o.text"))).otherwise(F.col("e.text")).alias("text"),
        F.coalesce(F.when(writes, given("run_id")), F.col("e.run_id"), F.lit("")).alias("run_id"),
        F.coalesce(F.when(writes, gates), F.col("e.gates"), F.array().cast(_NONE)).alias("gates"),
    )
    none = F.array().cast(_NONE)
    lost = F.when(F.col("done") & (op == "drop"), F.col("e.text"))
    judged = both.where("done is not null").select(case, F.col("o.at").alias("at"), op.alias("op"), "rule_id", F.when(F.col("done"), "applied").otherwise("rejected").alias("outcome"), none.alias("problems"), lost.alias("dropped_text"))
    void = rows.where("voided").select(case, "at", "op", "rule_id", F.when(F.size("problems") > 0, "problem").otherwise("voided").alias("outcome"), "problems", F.lit(None).cast("string").alias("dropped_text"))
    return after, judged.unionByName(void)
