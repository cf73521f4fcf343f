"""Laws of the operators that SQL can't state, and small fixtures."""

import random

from pyspark.sql import functions as F

from revlytics.functions import metrics
from revlytics.operators import changelog, diffs, matching
from revlytics.operators.numbering import running
from revlytics.plans import evaluation
from revlytics.sources.jsonl import read_cases, write_jsonl
from revlytics.streaming import jobs

DIFF = "diff --git a/app.py b/app.py\n--- a/app.py\n+++ b/app.py\n@@ -1,3 +1,4 @@\n first\n-old\n kept\n+new = 2\n+eval(x)\n@@ -20 +22 @@\n-gone\n+there\n"


def values(df):
    return sorted(map(tuple, df.collect()))


def test_added_lines(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "case_id int, diff string")
    assert values(diffs.added_lines(df)) == [(1, "app.py", 3, "new = 2"), (1, "app.py", 4, "eval(x)"), (1, "app.py", 22, "there")]


def test_added_lines_of_odd_diffs(spark):
    two = "--- a/x\n+++ b/x\n@@ -1,4 +1,5 @@\n one\n\n+three\n-gone\n\\ No newline at end of file\n+four\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-all\n+++ b/z\n+not in a hunk\n@@ -5 +7,2 @@ def f():\n+seven\n same\n+nine\n"
    df = spark.createDataFrame([(1, two), (2, "@@ -0,0 +1 @@\n+bare\n"), (1, "+++ b/w\n@@ -1 +1 @@\n+again")], "case_id int, diff string")
    want = [(1, "w", 1, "again"), (1, "x", 3, "three"), (1, "x", 4, "four"), (1, "z", 7, "seven"), (1, "z", 9, "nine"), (2, "unknown", 1, "bare")]
    assert values(diffs.added_lines(df)) == want


def test_diff_parts_and_fingerprint(spark):
    one = "diff --git a/p.py b/p.py\nindex 1..2\n--- a/p.py\n+++ b/p.py\n@@ -1 +1 @@\n-a \n+b\n"
    moved = one.replace("@@ -1 +1 @@", "@@ -9 +9 @@\n context").replace("-a ", "-a")
    other = one.replace("p.py", "q.py")
    df = spark.createDataFrame([(1, one + other), (2, "no header")], "case_id int, diff string")
    assert values(diffs.split_by_file(df)) == [(1, 0, "p.py", one), (1, 1, "q.py", other)]
    got = [r[0] for r in spark.createDataFrame([(one,), (moved,), (other,)], "d string").select(diffs.change_fingerprint(F.col("d"))).collect()]
    assert got[0] == got[1] != got[2]


def test_a_long_chain_matches_without_recursion():
    chain = [(k, k, 1) for k in range(3000)] + [(k + 1, k, 0) for k in range(2999)]
    assert len(matching.max_matching(chain)) == 3000


def test_reversal_is_an_involution(spark):
    df = spark.createDataFrame([(DIFF,)], "diff string")
    once = df.select(diffs.reverse_diff(F.col("diff")).alias("diff"))
    assert once.first()[0] != DIFF and once.select(diffs.reverse_diff(F.col("diff"))).first()[0] == DIFF


def brute_matching(edges):
    """The largest number of pairs, by trying every choice."""
    if not edges:
        return 0
    (p, t, _), rest = edges[0], edges[1:]
    return max(brute_matching(rest), 1 + brute_matching([e for e in rest if e[0] != p and e[1] != t]))


def test_matchers():
    rng = random.Random(3)
    for _ in range(200):
        edges = list({(rng.randint(0, 3), rng.randint(0, 3)): 0 for _ in range(rng.randint(0, 8))})
        edges = [(p, t, rng.randint(0, 2)) for p, t in edges]
        best, near = matching.max_matching(edges), matching.nearest_matching(edges)
        assert len(best) == brute_matching(edges) >= len(near)
        for got in (best, near):
            assert len(set(got.values())) == len(got) and all((p, t) in {(a, b) for a, b, _ in edges} for t, p in got.items())
    # One prediction between two truths: the greedy one takes the wrong truth.
    assert len(matching.max_matching([(1, 1, 0), (2, 1, 1), (1, 2, 0)])) == 2 and len(matching.nearest_matching([(1, 1, 0), (2, 1, 1), (1, 2, 0)])) == 1


def test_matching_queries_agree_with_the_edges(spark, sf):
    edges = {(r.case_id, r.p, r.t) for r in evaluation.interval_edges(spark, sf).collect()}
    best = evaluation.match_max(spark, sf).collect()
    assert best and all((r.case_id, r.p, r.t) in edges for r in best)
    found, truth = evaluation._sides(spark, sf)
    assert evaluation.unmatched_both_sides(spark, sf).count() == found.count() + truth.count() - 2 * len(best)


def test_null_is_not_a_pass(spark):
    df = spark.createDataFrame([(0.5, 0.4), (None, 0.4), (0.5, None), (None, None)], "c double, b double")
    c, b = F.col("c"), F.col("b")
    got = df.select(metrics.at_least(c, b), metrics.not_worse(c, b), metrics.non_regressing(c, b)).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (None, False, False), (None, False, True), (None, False, True)]
    assert df.agg(metrics.passes_all(metrics.at_least(c, b))).first()[0] is False


def test_published_wilson_bounds(spark):
    """Hits, samples and the interval they are known to have."""
    df = spark.createDataFrame([(90, 117, 0.6851, 0.8363), (5, 18, 0.1250, 0.5087), (57, 78, 0.6232, 0.8166)], "k long, n long, lo double, hi double")
    assert df.where((metrics.wilson(F.col("k"), F.col("n"), False) != F.col("lo")) | (metrics.wilson(F.col("k"), F.col("n"), True) != F.col("hi"))).isEmpty()
    assert spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0), True)).first()[0] is None


def test_changelog_views(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, None), (None, 1, "n")], "k string, seq int, v string")
    assert set(values(changelog.latest(log.where("k is not null"), ["k"], ["seq"]))) == {("a", 3, "z")}
    assert set(map(tuple, changelog.first(log, ["k"], ["seq"]).collect())) == {("a", 1, "x"), (None, 1, "n")}
    assert [r.conflict for r in changelog.immutable(log.where("k = 'a'"), ["k"], "v").collect()] == [True]


def test_running_sums_cross_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = running(df, ["k"], F.expr("id div 100"), [F.col("id")], {"s": F.col("id")})
    assert all(r.s == sum(range(r.k, r.id + 1, 3)) for r in got.collect())


def test_corpus_source(spark, tmp_path):
    lines = ['{"id":"1","split":"train","expected_findings":[{"path":"a","start_line":3,"end_line":2,"severity":"HIGH"}]}', "", '{"id":"2","split":"nowhere"}', '{"id":"2","split":"train"}', "{not json"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    got = sorted((r.id or "", r.split or "", tuple(r.problems)) for r in read_cases(spark, str(tmp_path / "c.jsonl")).collect())
    assert got == [("", "", ("corrupt", "no-id", "split")), ("1", "train", ("range",)), ("2", "nowhere", ("duplicate-id", "split")), ("2", "train", ("duplicate-id",))]
    write_jsonl(spark.createDataFrame([(1, "x", None)], "b int, a string, c string"), str(tmp_path / "out"))
    assert "".join(f.read_text() for f in (tmp_path / "out").glob("part*")) == '{"a":"x","b":1}\n'


def test_streams_equal_batches(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    jobs.first_deliveries(stream, "user_id").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination(90)
    assert spark.table("firsts").count() == batch.select("user_id").distinct().count()
    counts = jobs.error_counts(stream, "user_id", F.col("event_type") == "error", "ts", late="400 days")
    counts.writeStream.format("memory").queryName("budget").outputMode("update").trigger(availableNow=True).start().awaitTermination(90)
    got = spark.table("budget").agg(F.sum("samples"), F.sum("failures")).first()
    assert tuple(got) == (batch.count(), batch.where("event_type = 'error'").count())


def test_retry_plan(spark):
    df = spark.createDataFrame([(1, True, False), (1, False, True), (5, False, False), (3, False, False), (5, True, False)], "attempt int, ok boolean, permanent boolean")
    assert [(r.action, r.delay_s) for r in jobs.retry_plan(df).collect()] == [("done", None), ("dead", None), ("dead", None), ("retry", 4.0), ("done", None)]
