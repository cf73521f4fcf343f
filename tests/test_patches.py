"""Patches against a sequential fold, their reversal, and hand-made refusals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from revlytics.operators import diffs, patches

FILES = "case_id long, path string, content string"


def fold(patch, files):
    """Reads a patch from top to bottom: ({path: new text}, None) or (None, reason)."""
    todo, out, lines = [], {}, (patch or "").replace("\r\n", "\n").splitlines()
    i = 0
    while i < len(lines):
        if not lines[i].startswith("--- "):
            if lines[i].strip():
                return None, "content outside a file header"
            i += 1
            continue
        if i + 1 == len(lines) or not lines[i + 1].startswith("+++ "):
            return None, "no new-file header"
        old, new = (re.sub(f"^{m}/", "", lines[i + k][4:].split("\t")[0]) for k, m in ((0, "a"), (1, "b")))
        if old != new or new not in files:
            return None, "path not allowed"
        if new.startswith("/") or ".." in new.split("/"):
            return None, "unsafe path"
        i, hunks = i + 2, []
        while i < len(lines) and not lines[i].startswith("--- "):
            m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,(\d+))? @@", lines[i])
            if not m:
                if lines[i] == "\\ No newline at end of file":
                    i += 1
                    continue
                return None, "invalid hunk header"
            i, body = i + 1, []
            while i < len(lines) and not lines[i].startswith(("@@ ", "--- ")):
                if lines[i][:1] not in (" ", "+", "-", "\\"):
                    return None, "invalid patch line"
                body += [lines[i]] if lines[i][0] != "\\" else []
                i += 1
            if [sum(x[0] in s for x in body) for s in (" -", " +")] != [int(m[2] or 1), int(m[3] or 1)]:
                return None, "line counts differ"
            hunks.append((int(m[1]) - 1, body))
        if not hunks:
            return None, "file without hunks"
        todo.append((new, hunks))
    if not todo:
        return None, "no file patches"
    if len({p for p, _ in todo}) < len(todo):
        return None, "file named twice"
    for path, hunks in todo:
        own, new, at = files[path].splitlines(), [], 0
        for start, body in hunks:
            if start < at or start > len(own):
                return None, "overlapping or out of range"
            new += own[at:start]
            at = start
            for x in body:
                if x[0] != "+":
                    if at == len(own) or own[at] != x[1:]:
                        return None, "context differs"
                    at += 1
                if x[0] != "-":
                    new.append(x[1:])
        out[path] = "\n".join(new + own[at:]) + ("\n" if files[path].endswith("\n") else "")
    return out, None


def applied(spark, cases):
    """cases: list of (patch, {path: content}) -> list of what `fold` gives."""
    p = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "case_id long, patch string")
    f = spark.createDataFrame([(i, k, v) for i, (_, files) in enumerate(cases) for k, v in files.items()], FILES)
    out = [({}, None) for _ in cases]
    for r in patches.apply_patches(p, f).collect():
        if r["reason"]:
            assert out[r["case_id"]] == ({}, None)
            out[r["case_id"]] = (None, r["reason"])
        else:
            out[r["case_id"]][0][r["path"]] = r["content"]
    return out


def made(rng, path, text):
    """A valid patch of a text, with hunks of some context."""
    own, out, i, shift = text.splitlines(), [f"--- a/{path}", f"+++ b/{path}"], 0, 0
    while i <= len(own):
        n = rng.randrange(0, 4)
        body, old, new = [], 0, 0
        start = i
        for x in own[i : i + n]:
            kind = rng.choice(" -~")
            body += [" " + x] if kind == " " else ["-" + x] if kind == "-" else ["-" + x, "+" + x + "!"]
            old, new = old + 1, new + (kind != "-")
        if rng.random() < 0.4:
            body.append("+new %d" % rng.randrange(9))
            new += 1
        if body:
            out += [f"@@ -{start + 1},{old} +{start + 1 + shift},{new} @@", *body]
            shift += new - old
        i += n + rng.randrange(1, 4)
    return out if len(out) > 2 else out + ["@@ -1,0 +1 @@", "+only"]


def test_patches_are_the_fold(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(250):
        files = {p: "".join(rng.choice("abc") * rng.randrange(3) + "\n" for _ in range(rng.randrange(9))) + rng.choice(["", "end"]) for p in ("a.py", "d/b.py")}
        lines = [x for p in rng.sample(sorted(files), rng.randrange(1, 3)) for x in made(rng, p, files[p])]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):  # something wrong, perhaps
            k = rng.randrange(len(lines) + 1)
            odd = ["", "junk", "--- a/a.py", "--- a/zz", "+++ b/a.py", "@@ -1 +1 @@", "@@ -x @@", "\\ No newline at end of file", " c", "-c", "+c", "@@"]
            lines = rng.choice([lines[:k] + lines[k + 1 :], lines[:k] + [rng.choice(odd)] + lines[k:], lines[:k] + [rng.choice(odd)] + lines[k + 1 :]])
        cases.append(("\n".join(lines) + rng.choice(["", "\n"]), files))
    got, want = applied(spark, cases), [fold(*c) for c in cases]
    assert [(c, g, w) for c, g, w in zip(cases, got, want) if g != w][:1] == []
    assert len({w[1] for w in want}) >= 8 and sum(w[1] is None for w in want) > 50


def test_odd_patches(spark):
    files = {"a.py": "x\ny", "../b": "q\n", "/c": "q\n"}
    head = "--- a/a.py\n+++ b/a.py\n"
    cases = [
        (head + "@@ -2 +2 @@\n-y\n+z\n\\ No newline at end of file\n", files), (None, files), ("", {}), (" \n\n", files), ("--- a/a.py\t2020\r\n+++ b/a.py\t2021\r\n@@ -1,0 +1 @@ def f\r\n+w\r\n", files),
        ("--- a/../b\n+++ b/../b\n@@ -1 +1 @@\n-q\n+r", files), ("--- /c\n+++ /c\n@@ -1 +1 @@\n-q\n+r", files), (head, files), (head + "@@ -9,0 +9 @@\n+far", files), (head + "@@ -3,0 +3 @@\n+end", files),
        ("--- a/a.py", files), (head + head + "@@ -1 +1 @@\n x", files), ("--- a/a.py\n+++ b/d.py\n@@ -1 +1 @@\n x", files), (head + "@@ -1 +1 @@\n x\n" + head + "@@ -1 +1 @@\n x", files), (head + "@@ -1 +1 @@\n x\n--- a/../b\n+++ b/../b\n", files),
        (head + "@@ -2 +2 @@\n y\n@@ -1 +1 @@\n x", files), (head + "@@ -1,3 +1,3 @@\n x\n y\n z", files), (head + "@@ -0,0 +1 @@\n+w", files), (head + "@@ -1 +1 @@\n-x\n+X", {**files, "a.py": "x\r\ny\r\n"}),
    ]
    assert applied(spark, cases) == [fold(*c) for c in cases]


def test_reversal_gives_the_file_back(spark):
    rng = random.Random(9)
    cases = [(("\n".join(made(rng, "a.py", t)) + "\n"), {"a.py": t}) for t in ("".join(f"line {rng.randrange(50)}\n" for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    new = applied(spark, cases)
    back = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i long, p string").orderBy("i").select(diffs.reverse_diff(F.col("p"))).collect()
    # A hunk without old lines begins at its line here, so that its reverse begins at the line that it added.
    again = applied(spark, [(b[0], n[0]) for b, n in zip(back, new)])
    assert [a[0] for a in again] == [files for _, files in cases]


@pytest.mark.parametrize("rows", [[], [(1, "x")]])
def test_no_rows_and_several_patches(spark, rows):
    p = spark.createDataFrame(rows * 2, "case_id long, patch string")
    got = patches.apply_patches(p, spark.createDataFrame([(1, "a", None)], FILES)).collect()
    assert [(r["case_id"], r["reason"]) for r in got] == [(1, "several patches")][: len(rows)]


def test_a_long_file(spark):
    text = "".join(f"{i}\n" for i in range(60_000))
    patch = "--- a/f\n+++ b/f\n" + "".join(f"@@ -{i},1 +{i},1 @@\n-{i - 1}\n+{-i}\n" for i in range(1, 60_001, 3))
    got = applied(spark, [(patch, {"f": text})])[0][0]["f"].split("\n")
    assert got[:4] == ["-1", "1", "2", "-4"] and len(got) == 60_001
