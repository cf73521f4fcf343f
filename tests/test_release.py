"""Scores, protected metrics and decisions against plain Python; guards and arms by hand."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from revlytics.operators import release

CASE = "k int, expected int, tp int, fp int, fn int, severity_hits int, high_total int, high_hits int, ok boolean"


def four(x):
    """Four digits, halves up, as the library rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def scored(cases):
    s = lambda i: sum(x[i] for x in cases)
    div = lambda n, d: n / d if d else None
    tp, fp, fn = s(1), s(2), s(3)
    clean = [x for x in cases if x[0] == 0]
    out = {"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "severity_accuracy": div(s(4), tp), "clean_accuracy": div(sum(x[7] and x[1] + x[2] == 0 for x in clean), len(clean)), "high_severity_recall": div(s(6), s(5))}
    parts = [(out[n], w) for n, w in release.WEIGHTS.items() if (s(0) if n != "clean_accuracy" else len(clean))]
    parts = [(v, w) for v, w in parts if v is not None]
    top, under = 0.0, 0.0
    for v, w in parts:  # sum() would make up for rounding
        top, under = top + v * w, under + w
    score = top / under if parts else 0.0
    rounded = {k: None if v is None else four(v) for k, v in out.items()}
    return rounded | {"score": four(score * (sum(x[7] for x in cases) / len(cases))), "matched": tp, "severity_hits": s(4), "positive": len(cases) - len(clean), "clean": len(clean), "errors": sum(not x[7] for x in cases)}


def fallen(c, b, margin):
    names = ["score", "precision", "recall", "high_severity_recall"] + ["severity_accuracy"] * (b["positive"] > 0) + ["clean_accuracy"] * (b["clean"] > 0)
    bad, unknown = [], [n for n in names if b[n] is None]
    for n in names:
        ok = b[n] is None or (c[n] is not None and c[n] + margin >= b[n])
        if n == "severity_accuracy" and c["matched"] != b["matched"]:
            ok = c["severity_hits"] >= b["severity_hits"]
            unknown.append(n)
        bad += [n] * (not ok)
    return sorted(bad), sorted(set(unknown))


def cases_of(rng, lucky):
    out = []
    for _ in range(rng.randrange(1, 7)):
        expected = rng.choice([0, 1, 3])
        ok = rng.random() < 0.97
        tp = sum(rng.random() < lucky for _ in range(expected)) if ok else 0
        high = rng.randrange(expected + 1)
        out.append((expected, tp, int(rng.random() > lucky) if ok else 0, expected - tp, rng.randrange(tp + 1), high, min(high, tp), ok))
    return out


def test_decisions_are_those_of_plain_python(spark):
    rng = random.Random(8)
    runs = {k: [cases_of(rng, x) for x in ((0.8, 0.6, 0.8, 0.6) if k % 3 else (1.0, 0.1, 1.0, 0.1))] for k in range(150)}
    frames = [release.replay_metrics(spark.createDataFrame([(k, *x) for k, r in runs.items() for x in r[i]], CASE), ["k"]) for i in range(4)]
    pairs = None
    for name, df in zip(("c", "b", "ch", "bh"), frames):
        one = df.select("k", F.struct(*(x for x in df.columns if x != "k")).alias(name))
        pairs = one if pairs is None else pairs.join(one, "k")
    k = F.col("k")
    out = release.decided(pairs, k % 10 > 0, k % 10 != 1, k % 10 != 2, k % 2 == 0, 0.01, 0.02).collect()
    seen = set()
    for r in out:
        c, b, ch, bh = (scored(x) for x in runs[r["k"]])
        for got, want in zip((r["c"], r["b"], r["ch"], r["bh"]), (c, b, ch, bh)):
            assert {n: got[n] for n in ("score", "precision", "recall", "f1", "severity_accuracy", "clean_accuracy", "high_severity_recall")} == {n: want[n] for n in ("score", "precision", "recall", "f1", "severity_accuracy", "clean_accuracy", "high_severity_recall")}
        (bad, unknown), (hbad, _) = fallen(c, b, 0.02), fallen(ch, bh, 0.02)
        assert (r["validation"]["regressed"], r["validation"]["unmeasurable"]) == (bad, unknown)
        why = ["one or more evaluations failed"] * any(x["errors"] for x in (c, b, ch, bh)) + ["score improvement was below the threshold"] * (c["score"] < b["score"] + 0.01)
        why += [f"a protected validation metric regressed ({', '.join(bad)})"] * bool(bad) + [f"a protected holdout metric regressed ({', '.join(hbad)})"] * bool(hbad)
        m = r["k"] % 10
        want = ("rejected", ["unsafe or incomplete prompt"]) if m == 0 else ("deferred", ["too few validation cases"]) if m == 1 else ("deferred", ["too few holdout cases"]) if m == 2 else ("rejected", why) if why else ("activated" if r["k"] % 2 == 0 else "shadow_ready", [])
        assert (r["decision"], r["reasons"]) == want
        assert (r["evaluation_success"] is None) == (m < 3)
        seen.add(want[0])
    assert seen == {"rejected", "deferred", "activated", "shadow_ready"}


def test_guard_and_arms(spark):
    versions = spark.createDataFrame([("t", "s", 1, True), ("t", "s", 2, False), ("t", "s", 3, None), ("u", "s", 2, False)], "tenant string, skill string, version int, active boolean")
    runs = spark.createDataFrame([("t", "s", 2, "activated"), ("t", "s", 2, "activated"), ("t", "s", 3, "rejected")], "tenant string, skill string, candidate_version int, decision string")
    assert {(r["tenant"], r["version"]): r["allowed"] for r in release.may_activate(versions, runs, ["tenant", "skill"]).collect()} == {("t", 1): True, ("t", 2): True, ("t", 3): False, ("u", 2): False}
    a, b = spark.createDataFrame([(1, 0.5), (2, None)], "id int, v double"), spark.createDataFrame([(2, 1.0), (1, 0.25)], "id int, v double")
    assert sorted(tuple(r) for r in release.paired(a, b, [], "id", "v").collect()) == [(1, 0.5, 0.25), (2, None, 1.0)]
    for other in (b.where("id = 1"), b.unionByName(b)):
        with pytest.raises(Exception, match="arms differ at"):
            release.paired(a, other, [], "id", "v").collect()
