"""Verdicts, scopes, alignment, steadiness, readiness, safety, gates and activity by hand."""

from pyspark.sql import functions as F

from revlytics.operators import labels, readiness


def test_verdicts_keep_what_was_wrong(spark):
    rows = [("High ", "injection", "cwe-1", "0.5", "b" * 1200), (None, "odd", "n/a", "x", None), ("odd", " API-MISUSE", None, None, ""), ("low", "no-defect", "CWE-0", "7", "b"), ("low", "no-defect", "CWE-0", "-1e9", "b")]
    df = spark.createDataFrame(rows, "s string, d string, w string, c string, b string")
    got = [r[0] for r in df.select(labels.verdict(*(F.col(c) for c in "sdwcb"))).collect()]
    assert [(v["severity"], v["defect_class"], v["cwe"], v["confidence"], v["invalid_fields"]) for v in got] == [
        ("high", "injection", "CWE-1", 0.5, []), (None, None, "", 0.0, ["severity=null", "defect_class=odd", "confidence=x"]), (None, "api-misuse", "", 0.0, ["severity=odd"]), ("low", "no-defect", "", 1.0, []), ("low", "no-defect", "", 0.0, []),
    ]
    assert len(got[0]["basis"]) == 1000 and got[1]["basis"] == ""


def test_scopes_and_ids(spark):
    found = spark.createDataFrame([(1, 1, "b/src\\x.py", 8), (1, 2, "src/x.py", 13), (1, 3, "y.py", 10), (2, 1, "src/x.py", 10), (1, 4, None, 10)], "c int, k long, path string, line long")
    truth = spark.createDataFrame([(1, "a/src/x.py", 10, 10), (1, "src/x.py", 9, 11), (1, "y.py", 50, 60)], "c int, path string, start_line long, end_line long")
    assert {(r["c"], r["k"]): r["in_label_scope"] for r in labels.scoped(found, truth, "c", "k").collect()} == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False, (1, 4): False}
    assert [r[0] for r in spark.createDataFrame([("b/a/x",), ("apps/x",), ("/lib",)], "p string").select(labels.label_path(F.col("p"))).collect()] == ["x", "pps/x", "lib"]
    one = spark.createDataFrame([("k", "a\\b", 3, "R")], "c string, p string, l long, r string").select(labels.finding_id(F.col("c"), F.col("p"), F.col("l")), labels.alert_id(F.col("c"), F.col("p"), F.col("l"), F.col("r"))).first()
    assert one[0] == "k|a/b|3" and one[1] == __import__("hashlib").sha1(b"k|a/b|3|R").hexdigest()[:16]


def test_answers_are_aligned(spark):
    df = spark.createDataFrame([(1, ["x", "y"], ["ok"], None), (2, ["x"], ["ok", "more"], None), (3, ["x", "y"], ["ok"], "timeout"), (4, [], [], None), (5, ["x"], None, None)], "c int, e array<string>, v array<string>, error string")
    got = sorted((r["c"], r["place"], r["verdict"], r["state"]) for r in labels.answered(df, "c", "e", "v", "error").collect())
    assert got == [(1, 0, "ok", "answered"), (1, 1, None, "missing-verdict"), (2, 0, "ok", "answered"), (3, 0, None, "error"), (3, 1, None, "error"), (5, 0, None, "missing-verdict")]


def test_steadiness(spark):
    first = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, None), (2, 9, True)], "c int, place int, accepted boolean")
    second = spark.createDataFrame([(1, 0, True), (1, 1, True)], "c int, place int, accepted boolean")
    got = {r["c"]: (r["agreement"], r["flipped"]) for r in labels.steadiness(first, second, spark.createDataFrame([(1, 3), (2, 2), (3, 0)], "c int, candidates int"), "c").collect()}
    assert got == {1: (0.6667, [1]), 2: (1.0, []), 3: (None, [])}


def test_readiness(spark):
    rows = [("r1", "train", "public-github-pr"), ("r2", "validation", "private-historical-pr"), ("r3", "holdout", "public-github-pr")]
    df = spark.createDataFrame(rows, "repository string, split string, kind string")
    assert readiness.readiness(df, 3).first()["ready"] and not readiness.readiness(df, 4).first()["ready"]
    more = lambda *r: readiness.readiness(df.unionByName(spark.createDataFrame([r], df.schema)), 1).first()
    assert not more("r1", "holdout", "public-github-pr")["repository_isolation"] and not more("r4", "train", None)["real_provenance"] and not more("r4", "test", "public-github-pr")["known_splits"]
    none = readiness.readiness(df.where("false"), 0).first()
    assert not none["ready"] and none["cases"] == 0 and not none["train_present"]


def test_safety_gates_and_significance(spark):
    df = spark.createDataFrame([("Diff severity fix test json",), ("x" * 12_001,), (None,), ("please 直接执行生产",)], "p string")
    got = [r[0] for r in df.select(readiness.prompt_safety(F.col("p"))).collect()]
    assert [(s["safe"], s["completeness"], s["empty"], s["too_long"], len(s["forbidden"])) for s in got] == [(True, 1.0, False, False, 0), (False, 0.0, False, True, 0), (False, 0.0, True, False, 0), (False, 0.0, False, False, 1)]
    gates = spark.createDataFrame([({"b": False, "a": False, "c": None, "d": True, "flag": False},)], "g map<string, boolean>")
    assert gates.select(readiness.failing_gates(F.col("g"), ("a", "b", "c", "d"))).first()[0] == ["a", "b"]
    ci = spark.createDataFrame([(0.1,), (0.0,), (None,)], "low double")
    assert [r[0] for r in ci.select(readiness.surely_positive(F.col("low"))).collect()] == [True, False, False]


def test_activity_and_roles(spark):
    events = spark.createDataFrame([(1, "tool_observation", "git", True, 2), (1, "tool_observation", "git", False, 3), (1, "tool_observation", None, None, None), (1, "budget_exhausted", None, None, 1), (2, "note", "git", True, None)], "a int, event string, tool string, ok boolean, step int")
    got = {r["a"]: tuple(r)[1:] for r in readiness.activity(events, ["a"]).collect()}
    assert got == {1: (["git"], 2, 2, 3, True), 2: ([], 0, 0, 0, False)}
    cases = spark.createDataFrame([(1, {"critic": 2, "lead": 1}), (1, {"critic": 3}), (1, None)], "k int, roles map<string, int>")
    assert sorted(tuple(r) for r in readiness.role_calls(cases, ["k"], "roles").collect()) == [(1, "critic", 5), (1, "lead", 1)]
