"""Rules learned in turn, literals mined from misses, deletions as notices."""

import random

import pytest
from pyspark.sql import functions as F

from revlytics.operators import learning

FEEDBACK = "at int, category string, rule_id string, evidence string, severity string"


def test_rules_are_learned_in_turn(spark):
    rng = random.Random(4)
    start = [("R1", "a", "high"), ("R2", "b", "low"), ("R9", "z", "low")]
    rows = [(i, rng.choice(["missed_issue"] * 3 + ["false_positive", "accepted", None]), rng.choice([" r1", "R2", "R3", "R4 ", "no id", None]), rng.choice(["a", " a ", "b", "c", "", None, "x\ny", "q" * 241]), rng.choice(["LOW", None])) for i in range(300)]
    held, told = {"R1": ["a"], "R2": ["b"], "R9": ["z"]}, {}
    for i, category, rule, text, _ in rows:
        rule, text = (rule or "").strip().upper(), (text or "").strip()
        if rule in ("", "NO ID") or category not in ("missed_issue", "false_positive") or (category == "missed_issue" and (text in ("", "x\ny") or len(text) > 240)):
            told[i] = "ignored"
        elif category == "false_positive":
            told[i] = "removed" if held.pop(rule, []) else "nothing-to-remove"
        elif text in held.setdefault(rule, []):
            told[i] = "known"
        else:
            held[rule].append(text)
            told[i] = "added"
    after, outcomes = learning.learned_rules(spark.createDataFrame(start, "rule_id string, match string, severity string"), spark.createDataFrame(rows, FEEDBACK))
    assert {(r["rule_id"], r["match"]) for r in after.collect()} == {(k, m) for k, v in held.items() for m in v}
    assert {r["at"]: r["outcome"] for r in outcomes.collect()} == told
    nothing = learning.learned_rules(spark.createDataFrame(start, "rule_id string, match string, severity string"), spark.createDataFrame([], FEEDBACK))
    assert nothing[0].count() == 3 and nothing[1].count() == 0


def test_planted_literals_are_mined(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    noise = lambda: " ".join(word() for _ in range(6))
    missed = [("R1", f"{noise()} os.system( cmd ) {noise()}") for _ in range(12)] + [("R2", f"{noise()}\tyaml.load(  f ) {word()}") for _ in range(5)] + [("R2", f"return x {noise()}") for _ in range(9)] + [("R3", None), ("R3", "")]
    clean = [(f"{noise()} return x {noise()}",) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(missed, "rule_id string, content string")
    got = {(r["rule_id"], r["match"]): (r["support"], r["clean"]) for r in learning.mined_literals(df, spark.createDataFrame(clean, "content string"), least=5).collect()}
    assert got == {("R1", "os.system( cmd )"): (12, 0), ("R2", "yaml.load( f )"): (5, 0)}  # `return x` is over-broad: clean lines have it
    broad = learning.mined_literals(df, spark.createDataFrame(clean, "content string"), least=5, most_clean=1000).collect()
    assert ("R2", "return x", 9, 200) in [tuple(r) for r in broad]
    assert learning.mined_literals(df.where("false"), spark.createDataFrame(clean, "content string")).collect() == []


def test_deletions_are_notices(spark):
    rows = spark.createDataFrame([(1, "a", "s", 5, None), (2, "a", "t", 5, 9), (3, "b", "s", 5, None), (4, "b", "s", 9, 20), (5, None, "t", 1, None)], "id int, task string, scope string, created int, expires int")
    notices = spark.createDataFrame([(6, "a", "t"), (7, "b", None), (3, "a", None), (5, None, "t"), (0, None, "s")], "at int, task string, scope string")
    left = lambda df: sorted(r["id"] for r in df.collect())
    assert left(learning.without_deleted(rows, notices, ["task", "scope"])) == [1, 4]
    assert left(learning.without_deleted(rows, notices.where("at < 5"), ["task", "scope"])) == [1, 2, 3, 4, 5]  # an earlier state
    assert left(learning.without_deleted(rows, notices.where("false"), ["task", "scope"], F.lit(9))) == [1, 3, 4, 5]
    with pytest.raises(Exception, match="must name a key"):
        learning.without_deleted(rows, spark.createDataFrame([(1, None, None)], "at int, task string, scope string"), ["task", "scope"]).collect()
