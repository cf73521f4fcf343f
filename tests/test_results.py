"""Matching by bins and islands, consuming matches with severities, repairs and totals, against loops and by hand."""

import random

import pytest

from revlytics.operators import matching, results

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


@pytest.mark.parametrize("tolerance", [0, 2, 30])
def test_edges_are_all_near_pairs(spark, tolerance):
    rng = random.Random(tolerance)
    found = [(rng.randrange(3), i, rng.choice([None] + [rng.randrange(-40, 400)] * 20)) for i in range(150)]
    truth = [(rng.randrange(3), i, a, a + rng.choice([0, 0, 3, 90, -5])) for i, a in enumerate(rng.randrange(-40, 400) for _ in range(150))] + [(0, 999, None, 5)]
    f, t = spark.createDataFrame(found, "c int, p long, line long"), spark.createDataFrame(truth, "c int, t long, start long, end long")
    far = lambda x, a, b: max(0, a - x, x - b)
    want = {(c, p, t, far(x, a, b)) for c, p, x in found for k, t, a, b in truth if c == k and None not in (x, a) and far(x, a, b) <= tolerance}
    assert sorted(tuple(r) for r in matching.edges(f, t, ["c"], tolerance).collect()) == sorted(want)
    # Islands: no truth reaches out of its own, and two of a case don't touch.
    rows = matching.islands(t.where("start is not null"), ["c"], tolerance).collect()
    for c in range(3):
        spans = sorted((r["low"], r["high"]) for r in rows if r["c"] == c)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert all(any(low <= a - tolerance and max(a, b) + tolerance <= high for low, high in spans) for k, _, a, b in truth if k == c and a is not None)


def test_many_truths_and_findings_of_one_case_meet_nearby_only(spark):
    n = 20_000
    f, t = spark.range(n).selectExpr("1 as c", "id as p", "id * 3 as line"), spark.range(n).selectExpr("1 as c", "id as t", "id * 3 + 1 as start", "id * 3 + 1 as end")
    near = matching.edges(f, t, ["c"], 2)
    assert near.count() == 2 * n - 1
    assert matching.match(near, "c", matching.max_matching).count() == n


def test_findings_are_consumed_in_turn(spark):
    rng = random.Random(5)
    rules = [None, "", "R1", "R2"]
    found = [(c, rng.choice("ab"), rng.randrange(12), rng.choice(rules[1:]), rng.choice([*RANK, "odd", "HIGH"])) for c in range(60) for _ in range(rng.randrange(8))]
    truth = [(c, t, rng.choice("ab"), a, rng.choice([None, a, a + 2, a - 3]), rng.choice(rules), rng.choice([None, *RANK])) for c in range(60) for t, a in enumerate(rng.randrange(12) for _ in range(rng.randrange(6)))]
    want = set()
    for c in range(60):
        held = {}
        for k, path, line, rule, severity in found:
            if k == c:
                key = (path, line, rule)
                held[key] = max(held.get(key, 0), RANK.get(severity.lower(), 0))
        for k, t, path, a, b, rule, least in truth:
            if k != c:
                continue
            b = a if b is None or b < a else b
            near = [(max(0, a - x[1], x[1] - b), -held[x], x[1], x[2], x) for x in held if x[0] == path and max(0, a - x[1], x[1] - b) <= 2 and (not rule or x[2] == rule)]
            if near:
                d, _, _, _, x = min(near)
                want.add((c, t, d, held.pop(x) >= RANK.get(least, 1), RANK.get(least, 1) >= 3))
    f = spark.createDataFrame(found, "case_id int, path string, line long, rule_id string, severity string")
    t = spark.createDataFrame(truth, "case_id int, t long, path string, start long, end long, rule_id string, min_severity string")
    assert {tuple(r) for r in results.consumed(f, t).collect()} == want


def test_case_results_and_rates(spark):
    cases = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", None), (4, "b", False)], "case_id int, split string, failed boolean")
    truth = spark.createDataFrame([(1, 1, "High"), (1, 2, "low"), (2, 1, "critical")], "case_id int, t int, severity string")
    found = spark.createDataFrame([(1, 1, "medium"), (1, 2, "LOW"), (1, 3, "low"), (2, 1, "low"), (4, 1, "low")], "case_id int, p int, severity string")
    matched = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], "case_id int, t int, p int")
    out = results.case_results(cases, found, truth, matched)
    got = {r["case_id"]: tuple(r)[2:] for r in out.collect()}
    assert got == {1: (2, 3, 2, 1, 0, 1, 1, 1, False, True), 2: (1, 0, 0, 0, 1, 0, 1, 0, False, False), 3: (0, 0, 0, 0, 0, 0, 0, 0, True, True), 4: (0, 1, 0, 1, 0, 0, 0, 0, False, True)}
    rates = {r["split"]: r for r in results.run_metrics(out, ["split"]).collect()}
    assert (rates["a"]["precision"], rates["a"]["recall"], rates["a"]["high_risk_recall"], rates["a"]["clean_accuracy"]) == (0.6667, 0.6667, 0.5, 1.0)
    assert (rates["b"]["precision"], rates["b"]["recall"], rates["b"]["f1"], rates["b"]["severity_accuracy"], rates["b"]["high_risk_recall"]) == (0.0, None, None, None, None)
    repairs = spark.createDataFrame([(1, 1, "verified-draft"), (1, 2, "verified-draft"), (2, 1, "blocked")], "case_id int, t int, tier string")
    both = {r["case_id"]: (r["repair_attempted"], r["repair_passed"], r["repair_blocked"], r["e2e_success"]) for r in results.case_results(cases, found, truth, matched, repairs).collect()}
    assert both == {1: (2, 2, 0, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (0, 0, 0, False)}


def test_repair_tiers(spark):
    kind = "checks array<struct<name: string, passed: boolean>>, passed boolean, want string"
    rows = [
        ([("risk-reproduction", False), ("patch-generated", True)], True, "unreproduced"), ([("risk-reproduction", True)], True, "suggestion-only"), ([("patch-generated", None)], True, "suggestion-only"),
        ([("patch-generated", True), ("compile", False)], False, "blocked"), ([("patch-generated", True)], None, "blocked"), ([("patch-generated", True)], True, "verified-draft"), ([], True, "suggestion-only"), (None, True, "suggestion-only"),
    ]
    df = spark.createDataFrame(rows, kind)
    assert all(r[0] == r[1] for r in df.select(results.repair_tier(df["checks"], df["passed"]), "want").collect())
