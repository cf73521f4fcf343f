"""Laws and fixtures of scoring, replays and text functions."""

import pytest
from pyspark.sql import functions as F

from revlytics.functions import texts, weakness
from revlytics.operators import diffs
from revlytics.plans import replays, scoring


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_families_of_rule_ids(spark):
    want = {"CWE-617-reachable-assertion": "auth-bypass", "cwe_9999_weak-hash": "crypto-weak", "MD5-use": "crypto-weak", " ": "", None: "", "tls-version-leak": "crypto-weak", "REL": ""}
    rows = spark.createDataFrame([(k,) for k in want], "x string")
    got = {r["x"]: r["f"] for r in rows.select("x", weakness.rule_family(F.col("x")).alias("f")).collect()}
    assert got == want
    assert one(spark, "REL").select(weakness.rule_family(F.col("x"), {"REL": "CWE-400"})).first()[0] == "resource-leak"
    ids = {" cwe-89 ": "injection", "CWE-089": "", "CWE-noinfo": "", "CWE-99999999999": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in ids], "x string")
    assert {r["x"]: r["f"] for r in rows.select("x", weakness.weakness_family(F.col("x")).alias("f")).collect()} == ids


@pytest.mark.parametrize("text", ["", "abc", "é€😀z", "😀😀"])
def test_prefix_of_bytes_is_whole_characters(spark, text):
    for limit in range(-1, len(text.encode()) + 2):
        want = text.encode()[: max(0, limit)].decode("utf-8", "ignore")
        assert one(spark, text).select(texts.utf8_prefix(F.col("x"), F.lit(limit))).first()[0] == want


def test_cause_paths_are_those_of_posixpath(spark):
    import posixpath
    import re

    paths = ["a//b/./C.py", "../x/../../y", "/../q", ".env", "./", "", "a/..", "/", "x\\y\\..\\Z", "a/b/../../../c", " ./.github/ci.yml "]
    norm = lambda p: posixpath.normpath(re.sub(r"[\\/]+", "/", p.strip())) if p.strip() else ""
    want = {p: "" if norm(p) in (".", "/") else norm(p).lower() for p in paths}
    rows = spark.createDataFrame([(p,) for p in paths], "x string")
    assert {r["x"]: r["c"] for r in rows.select("x", texts.cause_path(F.col("x")).alias("c")).collect()} == want


def test_outcomes_of_a_log(spark):
    log = "t/a.py::x[1-2] PASSED\nFAILED t/a.py::x[1-2] - e\r\nERROR t/b.py::y\ny (m.T) ... skipped 'why'\ny (m.T) ... ok\nnoise PASSED\n"
    got = {r["test"]: r["outcome"] for r in texts.test_outcomes(spark.createDataFrame([(1, log), (2, None), (3, "")], "k int, log string"), "k", "log").collect()}
    assert got == {"t/a.py::x[1-2]": "failed", "t/b.py::y": "failed", "m.T.y": "passed"}


def test_outcomes_of_odd_logs(spark):
    lines = {
        "\ttests/a.py::t1 FAILED": ("tests/a.py::t1", "failed"), "tests/é.py::t3\u00a0FAILED": ("tests/é.py::t3", "failed"), "tests/b.py::K::t[x-1] PASSED   [ 33%]": ("tests/b.py::K::t[x-1]", "passed"),
        "ERROR tests\\c.py::t4: boom": ("tests/c.py::t4", "failed"), "SKIPPED tests/d.py::K::t:x::y": ("tests/d.py::K::t", "skipped"), "prüfe (m.Ü) [note x] ... ok": ("m.Ü.prüfe", "passed"),
        "t5 (m.K.t5)\t... expected failure": ("m.K.t5", "skipped"), "t6 (m.K) ... FAILED": None, "t7 (m.K) ...ok": None, "t8 (m.K)[x] ... ok": None, "a.py::t9 PASSEDX": None, "a.pyx::t PASSED": None,
        ".py::t PASSED": None, "a.py PASSED": None, "a.py:: PASSED": None, "a.py::t:x PASSED": None, "FAILED a.py::": None, "t10 (m.K) [open ... ok": None, "t11 (m.K) ... okay": None, "x-y (m.K) ... ok": None, "PASSED": None, "": None,
    }
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "k int, log string")
    got = {r["k"]: (r["test"], r["outcome"]) for r in texts.test_outcomes(rows, "k", "log").collect()}
    assert got == {i: want for i, want in enumerate(lines.values()) if want}


def test_long_diffs_are_split(spark):
    one = lambda name, n: f"diff --git a/{name} b/{name}\n@@ -1 +1,{n} @@\n" + "+line\n" * n
    text = "no file yet\n" + one("a.py", 200_000) + one(" b c.py", 3)[:-1]
    got = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "text only")], "case_id int, diff string")
    rows = diffs.split_by_file(got).collect()
    assert [(r["case_id"], r["at"], r["path"], r["chunk"].count("\n")) for r in rows] == [(1, 0, "a.py", 200_002), (1, 1, "b c.py", 5)]
    assert rows[1]["chunk"].startswith("diff --git a/ b c.py")
    mixed = spark.createDataFrame([(1, "diff --git a/x b/x\r\n+a\u2028+diff --git a/y b/y\u2028diff --git a/z b/z\n")], "case_id int, diff string")
    assert [(r["path"], r["chunk"]) for r in diffs.split_by_file(mixed).collect()] == [("x", "diff --git a/x b/x\n+a\n+diff --git a/y b/y\n"), ("z", "diff --git a/z b/z\n")]


def test_narrower_tiers_match_no_more(spark):
    found = spark.createDataFrame([(1, 3, 10, "CWE-89"), (1, 4, 11, "CWE-79"), (1, 9, 12, "CWE-601")], "case_id int, line long, p long, p_cwe string")
    truth = spark.createDataFrame([(1, 2, 3, 20, "CWE-78"), (1, 8, 8, 21, "CWE-601"), (1, 4, 4, 22, "CWE-89")], "case_id int, start long, end long, t long, t_cwe string")
    rows = scoring.tier_edges(found, truth, 2).collect()
    assert all(r["category"] or not r["exact"] for r in rows)
    assert {(r["p"], r["t"]) for r in rows if r["category"]} == {(10, 20), (11, 20), (10, 22), (11, 22), (12, 21)} - {(11, 20), (11, 22)}
    assert {(r["p"], r["t"]) for r in rows if r["exact"]} == {(10, 22), (12, 21)}


def test_failed_cases_miss_everything(spark):
    found = spark.createDataFrame([(1, 5, 1, "a"), (2, 5, 2, "a")], "case_id int, line long, p long, p_cwe string")
    truth = spark.createDataFrame([(1, 5, 5, 9, "a"), (2, 5, 5, 9, "a")], "case_id int, start long, end long, t long, t_cwe string")
    matched = spark.createDataFrame([(1, 9, 1), (2, 9, 2)], "case_id int, t long, p long")
    cases = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True)], "case_id int, failed boolean")
    got = {r["case_id"]: tuple(r)[2:] for r in scoring.case_counts(found, truth, matched, cases).collect()}
    assert got == {1: (1, 0, 0, None), 2: (0, 0, 1, None), 3: (0, 0, 0, True), 4: (0, 0, 0, False)}


def test_a_replay_without_its_key_ends_the_job(spark):
    asked, cache = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, None), (3, "x")], "k int, v string")
    assert replays.replayed(asked.where("k = 1"), cache, "k", "v").collect()[0]["v"] is None
    with pytest.raises(Exception, match="not in the replay cache: 2"):
        replays.replayed(asked, cache, "k", "v").collect()


def test_memories_said_twice_are_one(spark):
    rows = [("t", "r", "working", "k", " a ", 3.0, None, 5), ("t", "r", "working", "k", "a", 0.2, None, 9), ("t", "r", "episodic", "k", "b", -1.0, 0, 1), ("t", "r", "episodic", "k", "  ", 0.5, None, 1)]
    df = spark.createDataFrame(rows, "tenant string, repository string, scope string, kind string, content string, importance double, ttl long, created long")
    got = sorted((r["content"], r["importance"], r["expires"]) for r in scoring.remembered(df).collect())
    assert got == [("a", 0.2, 9 + scoring.WORKING_SECONDS), ("b", 0.0, None)]
