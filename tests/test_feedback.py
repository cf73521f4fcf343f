"""Worksheets, imports, promotions, writes and triage by hand."""

import pytest
from pyspark.sql import functions as F

from revlytics.operators import feedback


def test_worksheets_never_overwrite(spark):
    c = spark.createDataFrame([("a", None, "n", "R"), ("b", "", None, None), ("c", "valid", "old", None), ("d", "valid", None, None), ("e", None, None, None)], "candidate_id string, label string, note string, rule_id string")
    e = spark.createDataFrame([("a", "invalid", None, "R9"), ("b", "valid", "why", ""), ("c", "invalid", "x", "R1"), ("d", "valid", "x", None), ("e", "", "x", None), ("z", "valid", None, None)], "candidate_id string, label string, note string, rule_id string")
    merged, outcomes = feedback.worksheet_merged(c, e)
    assert {r[0]: tuple(r)[1:] for r in merged.collect()} == {"a": ("invalid", "", "R9"), "b": ("valid", "why", None), "c": ("valid", "old", None), "d": ("valid", None, None), "e": (None, None, None)}
    assert {r[0]: r[1] for r in outcomes.collect()} == {"a": "applied", "b": "applied", "c": "conflict", "d": "same", "e": "blank", "z": "unknown"}


def test_imports_have_one_outcome(spark):
    rows = [(1, "a", "unmatched_finding", "invalid"), (2, "a", "unmatched_finding", "invalid"), (3, "b", "unmatched_expected", "invalid"), (4, "c", "unmatched_expected", "should-have-caught"), (5, "d", None, "valid"), (6, "e", "unmatched_finding", None), (7, "f", "unmatched_finding", "unlabelled"), (8, "p", "unmatched_finding", "invalid")]
    df = spark.createDataFrame(rows, "at int, candidate_id string, kind string, label string")
    got = {r["at"]: (r["outcome"], r["category"]) for r in feedback.imported(df, spark.createDataFrame([("p",), ("p",)], "candidate_id string")).collect()}
    assert got == {1: ("imported", "false_positive"), 2: ("already_imported", None), 3: ("rejected", None), 4: ("imported", "missed_issue"), 5: ("rejected", None), 6: ("unconfirmed", None), 7: ("not_feedback", None), 8: ("already_imported", None)}
    again = feedback.imported(df, df.select("candidate_id"))  # run once more
    assert again.where("outcome = 'imported'").count() == 0


CORPUS = "id string, repository string, split string, diff string, n_expected int"
DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n a\n+b\n"


def test_a_repository_on_two_sides_stops_the_job(spark):
    df = spark.createDataFrame([("1", "r", "train", "", 0), ("2", "r", "holdout", "", 0), ("3", "", "train", "", 0)], CORPUS)
    with pytest.raises(Exception, match="in two splits: r"):
        feedback.repository_splits(df).collect()
    assert feedback.repository_splits(df.where("id <> '2'")).collect() == [("r", "train")]


def test_promotions_by_hand(spark):
    corpus = spark.createDataFrame([("k", "r", "train", DIFF, 0), ("d", "r", "train", DIFF, 2), ("h", "s", "holdout", DIFF, 0), ("n", None, "train", DIFF, 0), ("big", "r", "train", "x" * (feedback.DIFF_BYTES + 1), 0)], CORPUS)
    rows = [
        (1, "missed_issue", "k", "c1", "x.py", 2, " High ", " R "), (2, "missed_issue", "k", "c2", "x.py", 1, "high", None), (3, "false_positive", "k", None, None, None, None, None), (4, "false_positive", "d", "c", "x.py", 2, "low", None), (5, "missed_issue", "h", "c", "x.py", 2, "low", None),
        (6, "missed_issue", "n", "c", "x.py", 2, "low", None), (7, "missed_issue", "zz", "c", "x.py", 2, "low", None), (8, "missed_issue", "k", "c", None, 2, "low", None), (9, None, "k", "c", "x.py", 2, "low", None), (10, "accepted", "k", "c", "x.py", 2, "low", None), (11, "missed_issue", "big", "c", "x.py", 2, "low", None), (12, "missed_issue", "k", "c" * 200, "x.py", 2, "low", ""),
    ]
    df = spark.createDataFrame(rows, "id int, category string, case_id string, candidate_id string, path string, line long, severity string, rule_id string")
    out = feedback.promotions(df, corpus)
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {1: None, 2: "not-an-added-line", 3: None, 4: "clean-source-has-defects", 5: "hidden-split", 6: "unknown-repository", 7: "unknown-case", 8: "no-place", 9: "unconfirmed-category", 10: "refused-category", 11: "diff-too-large", 12: None}
    assert (got[1]["name"], got[1]["split"], got[1]["diff"], [tuple(x) for x in got[1]["expected"]]) == ("confirmed-missed_issue-c1", "train", DIFF, [("x.py", 2, "high", "R")])
    assert (got[3]["name"], got[3]["expected"]) == ("confirmed-false_positive-3", []) and len(got[12]["name"]) == 120 and got[12]["expected"][0]["rule_id"] is None
    total = feedback.plan_summary(out).first()
    assert (total["promoted"], total["refused"], total["clean"], total["by_split"]) == (3, 9, 1, {"train": 3})
    nothing = feedback.plan_summary(out.where("false")).first()
    assert (nothing["promoted"], nothing["by_reason"]) == (0, {})


def test_names_are_immutable(spark):
    plan = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4), ("c", None, 5), ("c", None, 6), ("d", "z", 7)], "name string, body string, at int")
    there = spark.createDataFrame([("b", "x"), ("d", "w")], "name string, body string")
    assert {r["at"]: r["outcome"] for r in feedback.written(plan, there, ["body"]).collect()} == {1: "written", 2: "existing", 3: "conflict", 4: "existing", 5: "written", 6: "existing", 7: "conflict"}


def test_triage_by_hand(spark):
    rows = [(1, "missed_issue", "A"), (2, "missed_issue", "A"), (3, "guess", "A"), (4, "bad_fix", "B"), (5, "accepted", "C"), (6, "missed_issue", "C")]
    tried = spark.createDataFrame([(2, "A", 1), (9, "C", 1), (9, "C", 2), (8, "C", 2)], "id int, cause string, run_id int")
    df = spark.createDataFrame(rows, "id int, category string, cause string")
    fates = lambda least, most: {r["id"]: r["fate"] for r in feedback.triaged(df, tried, least, most).collect()}
    assert fates(2, 2) == {1: "selected", 2: "attempted", 3: "inferred", 4: "sporadic", 5: "exhausted", 6: "exhausted"}
    assert fates(2, 0)[5] == "selected"
    c = spark.createDataFrame([("Missed", " r1", "a//B.py"), ("missed ", "R1", "A/./b.py"), (None, None, None)], "c string, r string, p string")
    keys = [r[0] for r in c.select(feedback.cause(F.col("c"), F.col("r"), F.col("p"))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[2]) == 16


def test_prior_attempts_are_ranked(spark):
    tried = spark.createDataFrame([(1, "A", 1, 5), (2, "A", 2, 5), (3, "B", 1, 5), (4, "A", 2, 6), (5, "C", 9, 5)], "row int, cause string, run_id int, baseline int")
    asked = spark.createDataFrame([("A",), ("B",), ("B",)], "cause string")
    got = feedback.prior_attempts(tried, asked, F.lit(5), 2)
    assert [(r["row"], r["place"], r["considered"]) for r in got.orderBy("place").collect()] == [(2, 1, 3), (1, 2, 3)]
    assert feedback.prior_attempts(tried, asked, F.lit(5), 0).count() == 3 and feedback.prior_attempts(tried, asked, F.lit(None), 2).count() == 0
