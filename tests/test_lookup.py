"""Searches, ranges, tests and evidence by hand."""

import pytest
from pyspark.sql import functions as F

from revlytics.operators import lookup


def test_searches_are_cut_by_key(spark):
    df = spark.createDataFrame([(1, i, "Hit " + "x" * 600) for i in range(5)] + [(2, 0, None), (2, 1, "miss"), (2, 2, "a HIT")], "k int, line int, content string")
    got = [(r["k"], r["line"], len(r["content"])) for r in lookup.searched(df, " hit", ["k"], 2).orderBy("k", "line").collect()]
    assert got == [(1, 0, 500), (1, 1, 500), (2, 2, 5)]
    assert lookup.searched(df, "hit", ["k"], 0).where("k = 1").count() == 1
    with pytest.raises(ValueError):
        lookup.searched(df, "  ", ["k"])


def test_ranges_are_clamped(spark):
    text = "".join(f"{i}\r\n" for i in range(1, 1201))
    rows = [(text, 2, 3), (text, -5, 1), (text, 10, 5), (text, 1, 1000), (text, 1199, 5000), (text, 3000, 3001), (None, 1, 5), ("one", 1, 9), ("x" * 50_000, 1, 1)]
    df = spark.createDataFrame(rows, "t string, a int, b int")
    got = [r[0] for r in df.select(lookup.read_range(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert [(g["start_line"], g["end_line"], len(g["content"])) for g in got] == [(2, 3, 6), (1, 1, 3), (10, 10, 4), (1, 500, 9 * 3 + 90 * 4 + 401 * 5), (1199, 1200, 12), (3000, 1200, 0), (1, 0, 0), (1, 1, 3), (1, 1, 40_000)]
    assert got[0]["content"] == "2\r\n3\r\n"


def test_tests_are_located(spark):
    files = spark.createDataFrame([(1, p) for p in ("tests/test_core.py", "tests/core_spec.rb", "src/core.py", "tests/other_test.py", "Test/Run.py")], "k int, path string")
    asked = spark.createDataFrame([(1, 1, "src/core.py", ""), (1, 2, None, "RUN"), (1, 3, None, None), (1, 4, "a/.env", None), (2, 5, None, None)], "k int, ask int, path string, symbol string")
    got = {}
    for r in lookup.located_tests(asked, files, ["k"], "ask").orderBy("ask", F.desc("relevance"), "path").collect():
        got.setdefault(r["ask"], []).append((r["path"], r["relevance"]))
    assert got == {1: [("tests/test_core.py", 2), ("tests/core_spec.rb", 1)], 2: [("Test/Run.py", 1)], 3: [("Test/Run.py", 0), ("tests/core_spec.rb", 0), ("tests/other_test.py", 0), ("tests/test_core.py", 0)]}


def test_evidence_is_taken_from_the_line(spark):
    found = spark.createDataFrame([("a", 1, " "), ("a", 1, "own"), ("a", 2, None), (None, 1, None)], "path string, line int, evidence string")
    added = spark.createDataFrame([("a", 1, "  x = 1 "), ("a", 1, "y")], "path string, line int, content string")
    got = [(r["evidence"], r["found"]) for r in lookup.with_evidence(found, added, []).collect()]
    assert sorted(got, key=str) == sorted([("x = 1", True), ("own", True), (None, False), (None, False)], key=str)
