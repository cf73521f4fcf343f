"""Rule scans against Python's own patterns, literals against containment rule by rule, and what many rules cost."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from revlytics.operators import scanners

LINES = "case_id long, path string, line long, content string"


def test_line_rules_are_the_patterns(spark):
    rng = random.Random(2)
    bits = ["eval", "exec", " (", "(", "shell", " = ", "=", "True", "api_key", "API-KEY", "token", "'", '"', "abcd", "execute", "query", "f", "+", "%", "except", " ", "Exception", ":", "pass", "print", "console.log", "é", "_", " ", "while", "yaml.load", "TODO"]
    rows = [(1, rng.choice(["a.py", "a.min.js", "b.lock", "tests/x.py", "x.map"]), i, "".join(rng.choices(bits, k=rng.randrange(7)))) for i in range(4000)] + [(1, None, -1, "eval(x)"), (1, "a.py", -2, None), (1, "a.py", -3, "")]
    df = spark.createDataFrame(rows, LINES)
    for rules in (scanners.LINE_RULES, scanners.EXTRA_RULES, scanners.UNFINISHED_RULES):
        got = {(r["line"], r["rule_id"]) for r in scanners.scanned(df, rules, 0.9, scanners.GENERATED_SUFFIXES, scanners.TEST_PREFIXES).collect()}
        want = {(n, r) for _, path, n, text in rows for r, _, p in rules if text is not None and re.search(p, text) and not (path or "").endswith(scanners.GENERATED_SUFFIXES) and not (path or "").startswith("tests/")}
        assert got == want and want
    assert scanners.scanned(df.where("false"), scanners.LINE_RULES, 0.9).collect() == []


def test_prompts_switch_rules_on(spark):
    df = spark.createDataFrame([(1, "a.py", 1, "yaml.load(x)"), (1, "a.py", 2, "hashlib.md5(eval(x))"), (1, "a.py", 1, "yaml.load(x)")], LINES)
    run = lambda prompt: sorted((r["line"], r["rule_id"]) for r in scanners.first_findings(scanners.policy_findings(df, scanners.switched_on(F.lit(prompt).cast("string"))), "case_id", "content").collect())
    assert run(None) == run("focus-rule:SEC-YAML-LOAD [focus-rule:sec-weak-hash]") == [(2, "SEC-EVAL")]
    assert run("x[focus-rule:SEC-YAML-LOAD][focus-rule:SEC-WEAK-HASH]") == [(1, "SEC-YAML-LOAD"), (2, "SEC-EVAL"), (2, "SEC-WEAK-HASH")]
    assert {r for ids in scanners.SPECIALISTS.values() for r in ids} == {r for r, _, _ in scanners.LINE_RULES}


def literal_rules(rng, n, letters="abcé", longest=9):
    return [{"rule_id": f"R-{rng.randrange(n)}", "severity": rng.choice(["low", "high"]), "match": "".join(rng.choices(letters, k=rng.randrange(1, longest))), "ignore_case": rng.random() < 0.3, "include_paths": rng.choice([[], [], ["src/", "lib"]]), "exclude_paths": rng.choice([[], ["tests/", "src/x"]])} for _ in range(n)]


@pytest.mark.parametrize("n", [1, 12, 300])
def test_literals_are_contained(spark, n):
    rng = random.Random(n)
    rules = literal_rules(rng, n)
    rows = [(1, rng.choice(["src/a", "src/x", "lib", "tests/b", "", None]), i, "".join(rng.choices("abcABéÉ ", k=rng.randrange(0, 30)))) for i in range(500)] + [(1, "lib", -1, None), (1, "lib", -2, "a" * 20_000)]
    want = {}
    for _, path, i, text in rows:
        for r in sorted(rules, key=lambda r: (r["rule_id"], r["match"])):
            p, held = path or "", (text or "").lower() if r["ignore_case"] else text or ""
            if (r["match"].lower() if r["ignore_case"] else r["match"]) in held and (not r["include_paths"] or p.startswith(tuple(r["include_paths"]))) and not p.startswith(tuple(r["exclude_paths"] or ["\0"])):
                want.setdefault((i, r["rule_id"]), r["severity"])
    got = {(r["line"], r["rule_id"]): r["severity"] for r in scanners.literal_findings(spark.createDataFrame(rows, LINES).repartition(3), rules).collect()}
    assert got == want


def test_a_thousand_literals_cost_less_than_twice_ten():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz_(.", k=rng.randrange(5, 14))) for _ in range(1000)]
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz_(. ", k=60)) for _ in range(20_000)]
    body, offsets = "".join(lines).encode(), [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x))
    import numpy as np

    def seconds(n):
        finder, least = scanners._Literals([w.encode() for w in words[:n]]), 9.0
        for _ in range(5):
            start = time.process_time()
            finder.find(body, np.array(offsets))
            least = min(least, time.process_time() - start)
        return least

    assert seconds(1000) < 2 * seconds(10)


def test_artifacts_are_checked():
    good = {"rule_id": " ev-1 ", "match": " x ", "confidence": 0.12344}
    assert scanners.checked_rules([good]) == [{"rule_id": "EV-1", "severity": "medium", "match": "x", "ignore_case": False, "confidence": 0.1234, "include_paths": [], "exclude_paths": ["tests/"]}]
    for bad in ({"rule_id": "1x"}, {"severity": "fatal"}, {"match": " "}, {"match": "a\nb"}, {"match": "y" * 241}, {"confidence": 1.2}, {"include_paths": "src/"}, {"exclude_paths": [1]}):
        with pytest.raises(ValueError):
            scanners.checked_rules([good | bad])
    with pytest.raises(ValueError, match="twice"):
        scanners.checked_rules([good, good])
    with pytest.raises(ValueError, match="at most"):
        scanners.checked_rules([good | {"match": str(i)} for i in range(101)])
