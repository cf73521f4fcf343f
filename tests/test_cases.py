"""Screens against Python's patterns, defect classes and difficulty by hand, cases from diffs by hand."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from revlytics.functions import screening
from revlytics.operators import cases

WORDS = ["fix", "Fixes", "#12", "bug", "revert", "reverting", "docs:", "Docs", "comment", "v1.2", "1.2.3rc1", "upgrade", "to", "v3", "deps", "backport", "[3.1]", "cleanup", "clean up", "CVE-2024-12345", "GHSA-abcd-ef12-3456", "race condition", "off-by-one", "éfix", "format_x", "closes", "\n", "typo", "2.0", ":", "(", "x"]


def test_screens_are_the_patterns(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None] + [" ".join(rng.choices(WORDS, k=rng.randrange(1, 5)))] * 30), rng.choice([None, "", " ".join(rng.choices(WORDS, k=3))])) for i in range(1500)]

    def subject(t):
        for p, why in ((screening.BACKPORT_PATTERN, "backport-duplicate"), (screening.EXCLUDE_KEYWORDS, "excluded-keyword"), (screening.RELEASE_TITLE, "release-commit"), (screening.DEPENDENCY_UPGRADE, "excluded-keyword"), (screening.SUBJECT_ONLY_PREFIX, "excluded-keyword")):
            if re.search(p, t):
                return why

    want = {}
    for i, t, b in rows:
        both, s = f"{t or ''}\n{b or ''}", subject(t or "")
        fix = bool(re.search(screening.FIX_KEYWORDS, both))
        label = "cve" if re.search(screening.CVE_PATTERN, both) else "linked-issue" if re.search(screening.LINKED_ISSUE, both) else "title-keyword"
        want[i] = (s or (None if fix else "not-a-bugfix"), s or ("looks-like-a-bugfix" if fix else None), label)
    t, b = F.col("t"), F.col("b")
    got = spark.createDataFrame(rows, "i long, t string, b string").select("i", screening.screen_fix(t, b), screening.screen_clean(t, b), screening.label_provenance(t, b)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len({w[0] for w in want.values()}) == 5


def test_classes_are_tried_in_order(spark):
    rows = [("x = hashlib.md5(y)\nif a < b:", "", "crypto-weak", "code-pattern"), ("yaml.load(f)", "", "injection", "code-pattern"), ("yaml.load(f, Loader=L)", "", "logic-boundary", "fallback-default"), ("p = '../x'", "", "path-traversal", "code-pattern"), ("pass", "A race", "logic-boundary", "fallback-default"), ("pass", "Resource freed", "resource-leak", "title-word"), ("pass", "Input checked", "input-validation", "title-word"), ("", None, "logic-boundary", "fallback-default"), ("not x", "injection", "logic-boundary", "code-pattern")]
    got = spark.createDataFrame(rows, "code string, title string, name string, basis string").select(screening.defect_class(F.col("code"), F.col("title")).alias("d"), "name", "basis").collect()
    assert [(r["d"]["name"], r["d"]["basis"]) for r in got] == [(r["name"], r["basis"]) for r in got]
    grades = [(["eval(x)"], 1, 1, "injection", "L1"), (["eval(x)", "y"], 1, 1, "injection", "L2"), (["eval(x)"], 2, 1, "injection", "L3"), (["x"], 1, 2, "injection", "L3"), (["x"], 3, 3, "concurrency", "L4"), (["x"], 1, 1, "crypto-weak", "L2")]
    df = spark.createDataFrame(grades, "seeds array<string>, files int, functions int, name string, want string")
    assert all(r[0] == r[1] for r in df.select(screening.difficulty(F.col("seeds"), F.col("files"), F.col("functions"), F.col("name")), "want").collect())
    paths = {"tests/a.py": True, "a/test/b": True, "test_a.py": True, "a/test_b.py": True, "a\\tests\\b": True, "x_test.py": True, "latest/a.py": False, "contest.py": False, "a/testing/x": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", screening.is_test_path(F.col("p"))).collect()
    assert {r[0]: r[1] for r in got} == paths


def pulls(spark, rows):
    return spark.createDataFrame([(str(i), "o/r", i, title, body, when, diff, None) for i, (title, body, when, diff) in enumerate(rows)], cases.PULL)


def test_cases_from_diffs(spark):
    when = dt.datetime(2024, 5, 1)
    file = lambda p, body: f"diff --git a/{p} b/{p}\nindex 1..2 100644\n--- a/{p}\n+++ b/{p}\n{body}"
    good = file("a.py", "@@ -10,4 +10,3 @@ def outer():\n ctx\n-x = 1 + 1\n-\n-y = 2\n+z = 3\n+def inner(): pass\n")
    rows = [("fix a", None, when, good), ("fix b", "", when, file("a.py", "@@ -1,2 +1 @@\n-\n-  # only notes\n+x\n")), (None, None, when, good), ("fix c", "", when, None), ("fix", "", when, good + "\\ No newline at end of file\n"), ("Fix CVE-2020-1234", "", None, good)]
    got = {r["key"]: r for r in cases.built_cases(pulls(spark, rows), "holdout", dt.datetime(2024, 1, 1), "web").collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"0": None, "1": "fix-adds-only", "2": "not-a-bugfix", "3": "empty-diff", "4": "unsupported-diff", "5": None}
    one = got["0"]
    assert (one["id"], one["contamination_split"], one["difficulty"], one["label_provenance"], one["domain"], one["split"]) == ("o__r-pr-0", "post-cutoff", "L3", "title-keyword", "web", "holdout")
    assert [(f["path"], f["start_line"], f["end_line"], f["cwe"]) for f in one["expected_findings"]] == [("a.py", 11, 11, "CWE-193"), ("a.py", 13, 13, "CWE-193")]
    assert one["human_patch"] == good and "index" not in one["diff"] and "+x = 1 + 1" in one["diff"]
    assert got["5"]["label_provenance"] == "cve" and got["3"]["id"] is None
    assert cases.built_cases(pulls(spark, rows).where("false"), "train", when).collect() == []


def test_clean_cases_wait(spark):
    day = dt.datetime(2024, 1, 1, 12)
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-a\n+b\n"
    rows = [("add x", "", day, diff), ("add x", "", day + dt.timedelta(seconds=1), diff), ("fix x", "", day, diff), ("add x", "", day, diff.replace("+b\n", "")), ("add x", "", None, diff)]
    got = {r["key"]: r for r in cases.built_clean_cases(pulls(spark, rows), "train", day, day + dt.timedelta(days=cases.CLEAN_DAYS)).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"0": None, "1": "cooldown-not-elapsed", "2": "looks-like-a-bugfix", "3": "no-added-lines", "4": "cooldown-not-elapsed"}
    assert got["0"]["diff"] == diff and got["0"]["expected_findings"] == [] and got["0"]["human_patch"] == "" and got["0"]["id"] == "o__r-pr-0-clean"
