"""Greedy folds against plain loops, diffs within a budget, shortest scripts against an LCS table, scopes by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlytics.functions import texts
from revlytics.operators import alignment, folds

DIFFS = "case_id long, diff string"


def greedy(hunks, budget, terms, mark=folds.OMITTED):
    """hunks: (hunk, path, header, text, score) -> {hunk: (decision, text)}, as a loop over the whole list."""
    used, paid, out, size = 0, set(), {}, lambda x: len(x.encode())
    for n, path, header, text, _ in sorted(hunks, key=lambda h: (-h[4], h[0])):
        fee = 0 if path in paid else size(header)
        short = folds.compact(text, budget - used - fee, terms, mark)
        if used + fee + size(text) <= budget:
            out[n] = ("kept", text)
        elif short:
            out[n] = ("compacted", short)
        if n in out:
            used += fee + size(out[n][1])
            paid.add(path)
        if out.get(n, ("",))[0] != "kept" and used >= budget:
            break
    if not out and hunks:
        best = min(hunks, key=lambda h: (-h[4], h[0]))
        out[best[0]] = ("compacted", folds.compact(best[3], budget, terms, mark) or best[3][:budget])
    return {h[0]: out.get(h[0], ("dropped", None)) for h in hunks}


@pytest.mark.parametrize("seed", range(3))
def test_hunks_in_budget_are_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["+", "-", " ", "+++"]) + rng.choice(["é", "x", "token ", ""]) * rng.randrange(40) + rng.choice(["\n", "\r\n", " ", "\n"])
    cases = {c: [(h, rng.choice("abc"), "--- é\n" * rng.randrange(3), "@@ -1 +1 @@\n" * rng.randrange(2) + "".join(line() for _ in range(rng.randrange(30))), float(rng.randrange(4))) for h in range(rng.choice([1, 4, 30]))] for c in range(60)}
    for budget in (1, 130, 700, 4000):
        df = spark.createDataFrame([(c, *h) for c, hunks in cases.items() for h in hunks], "case_id long, hunk long, path string, header string, text string, score double").repartition(3)
        got = {(r["case_id"], r["hunk"]): (r["decision"], r["text"]) for r in folds.chosen_hunks(df, budget, ("token",)).collect()}
        assert got == {(c, h): x for c, hunks in cases.items() for h, x in greedy(hunks, budget, ("token",)).items()}


def test_a_compact_hunk_keeps_risky_lines_and_their_neighbours():
    text = "@@ -1,9 +1,9 @@\n" + "".join(f" context {i}\n" for i in range(20)) + "-eval(x)\n" + "".join(f"+added {i}\n" for i in range(20))
    got = folds.compact(text, 200, ("eval(",))
    assert got.startswith("@@ -1,9 +1,9 @@\n" + folds.OMITTED + " context 19\n-eval(x)\n+added 0\n+added 1\n") and len(got) <= 200
    assert folds.compact(text, 127, ()) == "" and folds.compact("", 999, ()) == ""


def test_one_case_with_very_many_hunks(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("case_id"), F.col("id").alias("hunk"), F.format_string("p%d", F.col("id") % 50).alias("path"), F.lit("h\n").alias("header"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"), (F.col("id") % 11).cast("double").alias("score"))
    got = {r["hunk"]: (r["decision"], r["text"]) for r in folds.chosen_hunks(df.repartition(8), 60_000).collect()}
    want = greedy([(i, f"p{i % 50}", "h\n", "x" * (i % 97), float(i % 11)) for i in range(n)], 60_000, ())
    assert got == want


def test_diffs_in_budget(spark):
    file = lambda p, n: f"--- a/{p}\n+++ b/{p}\n" + "".join(f"@@ -{i} +{i} @@ {p}\n" + "+line of text\n" * 40 for i in range(n))
    long_ = "preface\n" + file("b.py", 3) + file("auth.py", 2) + "--- a/bare.py\n+++ b/bare.py\nno hunks\n"
    rows = spark.createDataFrame([(1, long_), (2, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+short\n"), (3, None), (4, "")], DIFFS)
    hunks = {(r["path"], r["header"], r["text"].split("\n")[0]) for r in folds.diff_hunks(rows.where("case_id = 1")).collect()}
    assert ("unknown", "preface\n", "preface") in hunks and ("bare.py", "--- a/bare.py\n+++ b/bare.py\n", "--- a/bare.py") in hunks and ("auth.py", "--- a/auth.py\n+++ b/auth.py\n", "@@ -1 +1 @@ auth.py") in hunks and len(hunks) == 7
    score = lambda path, text: texts.hunk_score(path, text, ("auth",))
    got = {r["case_id"]: r for r in folds.bounded_diffs(rows, 300, ("auth",), score).collect()}
    assert got[2]["text"] == rows.collect()[1]["diff"] and not got[2]["compressed"] and (got[3]["text"], got[3]["tokens"]) == ("", 1)
    one = got[1]
    assert one["compressed"] and one["tokens"] <= 301 and "auth.py" in one["text"] and one["text"].endswith("\n") and one["omitted_files"] + one["omitted_hunks"] > 0
    assert one["text"].index("--- a/b.py") < one["text"].index("--- a/auth.py") if "--- a/b.py" in one["text"] else True


def test_records_in_budget(spark):
    rng = random.Random(7)
    rows = [(c, p, rng.choice([None, "é", "ab", "漢"]) and rng.choice(["é", "ab", "漢"]) * rng.randrange(60), rng.choice([True, False, None])) for c in range(50) for p in range(rng.randrange(1, 12))]
    got = {(r["case_id"], r["place"]): (r["decision"], r["text"]) for r in folds.packed_records(spark.createDataFrame(rows, "case_id long, place long, text string, optional boolean"), 200).collect()}
    want, used = {}, {}
    for c, p, text, optional in rows:
        data, left = (text or "").encode(), 200 - used.get(c, 0)
        cut = data[:left].decode("utf-8", "ignore") if left >= 48 and not optional else ""
        want[c, p] = ("kept", text or "") if len(data) <= left else ("clipped", cut + "\n") if cut else ("dropped", None)
        used[c] = used.get(c, 0) + len((want[c, p][1] or "").encode())
    assert got == want


def table_length(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_scripts_are_shortest():
    rng = random.Random(1)
    for _ in range(800):
        k = rng.choice([1, 2, 3, 6])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(16))] for _ in range(2))
        p = alignment.matched(np.array(a, np.int64), np.array(b, np.int64))
        assert (np.diff(p[p >= 0]) > 0).all() and all(a[i] == b[j] for i, j in enumerate(p) if j >= 0)
        assert (p >= 0).sum() == table_length(a, b)
        blocks = alignment.changed_blocks(p, len(b))
        assert sum(i2 - i1 + j2 - j1 for i1, i2, j1, j2 in blocks) == len(a) + len(b) - 2 * (p >= 0).sum()
        assert all(x < y or z < w for x, y, z, w in blocks)


def test_long_texts_are_aligned():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5000, 50_000)
    b = np.delete(a, rng.choice(50_000, 500, replace=False))
    p = alignment.matched(a, b)
    assert (p >= 0).sum() == len(b)


def test_scopes(spark):
    old = "".join(f"{i}\n" for i in range(1, 31))
    rows = [
        (1, old, old, 5), (2, old, old.replace("\n7\n", "\nx\n"), 5), (3, old, old.replace("\n20\n", "\n"), 5), (4, old, "import os\nfrom a import b\n" + old, 20), (5, old, "import os\ncode\n" + old, 20),
        (6, None, None, 1), (7, "a", None, 1), (8, None, "a\nb", 1), (9, old, old + "end\n", 26), (10, "same\r\n", "same\n", 1),
    ]
    df = spark.createDataFrame(rows, "k long, before string, after string, line int")
    got = {r["k"]: tuple(r)[1:] for r in alignment.patch_scope(df, F.col("before"), F.col("after"), "line", ["k"]).collect()}
    assert got == {
        1: ([], [], 0, True), 2: ([7], [], 0, True), 3: ([20], [20], 0, False), 4: ([1], [], 1, True), 5: ([1], [1], 0, False),
        6: ([], [], 0, True), 7: ([1], [], 0, True), 8: ([1], [], 0, True), 9: ([31], [], 0, True), 10: ([], [], 0, True),
    }
