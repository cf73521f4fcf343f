"""Queries on tables like larger ones: keys beyond the small tables' ranges, and how their work is spread."""

import random
import re

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from revlytics import catalog
from revlytics.operators import alignment
from revlytics.operators.diffs import added_in, added_lines
from revlytics.sources.lines import numbered_lines


def compared(spark, folder, name: str, table: str) -> list:
    """Rows of a query, which must be those of its SQL on the one table that it reads."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return rows


def test_matching_sizes_with_large_numbers(spark, tmp_path):
    # The truth of part 1,150,000 ends at line 3, that of part 2 at line 4; its number puts it after the other for all that. Parts 1 and 3 are predictions at lines 4 and 6.
    rows = "(7, 1150000, 2, 2), (7, 2, 1, 2), (7, 1, 1, 4), (7, 3, 1, 6), (8, 4, 1, 1), (8, 5, 1, 1), (9, 1, 5, 1)"
    duckdb.execute(f"copy (select l_orderkey::bigint as l_orderkey, l_partkey::bigint as l_partkey, l_suppkey::bigint as l_suppkey, l_linenumber::int as l_linenumber from (values {rows}) v(l_orderkey, l_partkey, l_suppkey, l_linenumber)) to '{tmp_path}/lineitem.parquet'")
    assert sorted(compared(spark, tmp_path, "matching_sizes", "lineitem")) == [(7, 1, 1, 1), (8, 1, 0, 0), (9, 0, 0, 1)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_cases_are_spread_and_stay_in_their_rows(spark, sf):
    made = plan(catalog.QUERIES["clean_case_funnel"](spark, sf))
    assert "REPARTITION_BY_NUM" in made and "Join" not in made and "Window" not in made


def test_added_lines_in_a_row_equal_those_by_lines(spark):
    pieces = [
        "diff --git a/x b/x", "--- a/x.py", "+++ b/x.py", "+++ b/ y.py\t", "+++ ", "+++z", "@@ -1,2 +7,3 @@ def f", "@@ -1 +1 @@", "@@ bad", "+new", "+", "-old", "---", "--- b", " ctx", "", "\\ No newline at end of file", "\\x", "+++", "+@@ -1 +5 @@",
    ]
    draw = random.Random(3)
    texts = [None, "", "+a", *("\n".join(draw.choice(pieces) for _ in range(draw.randint(1, 14))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "case_id long, diff string")
    want = sorted(tuple(r) for r in added_lines(df).collect())
    got = df.select("case_id", F.explode(added_in(F.col("diff"))).alias("x")).select("case_id", "x.*")
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_fix_cases_are_spread_and_stay_in_their_rows(spark, sf):
    made = plan(catalog.QUERIES["fix_cases"](spark, sf))
    assert "REPARTITION_BY_NUM" in made and "Join" not in made and "Window" not in made


def test_logs_are_spread_and_read_once(spark, sf):
    made = plan(catalog.QUERIES["parsed_test_outcomes"](spark, sf))
    assert "REPARTITION_BY_NUM" in made
    assert not re.search(r"Filter .*RLIKE", made)


def test_diffs_are_spread_and_turned_once(spark, sf):
    made = plan(catalog.QUERIES["diff_reverse"](spark, sf))
    assert "REPARTITION_BY_NUM" in made
    assert made.count("split(") == 4  # those of one reading by line; more when lines were turned for each use


def test_prompts_are_spread(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES["prompt_safety"](spark, sf))


def test_tiers_are_matched_in_one_pass(spark, sf):
    assert plan(catalog.QUERIES["tier_scores"](spark, sf)).count("MapInArrow") == 1  # one for each tier before


def test_both_sides_are_sorted_in_small_parts(spark, sf):
    made = plan(catalog.QUERIES["unmatched_both_sides"](spark, sf))
    assert made.count("REPARTITION_BY_NUM") >= 4


def test_files_in_parts_are_numbered_on(spark, tmp_path):
    for name, text in (("b=1/part-00000", "x\ny\n"), ("b=1/part-00001", ""), ("b=1/part-00002", "z\n"), ("b=2/part-00001", "u\n"), ("b=2/part-00003", "v\nw")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = numbered_lines(spark, str(tmp_path), in_parts=True).select("line", "value").collect()
    assert sorted(map(tuple, got)) == [(1, "u"), (1, "x"), (2, "v"), (2, "y"), (3, "w"), (3, "z")]


def test_json_lines_are_written_by_many_tasks(spark, sf, tmp_path):
    rows = catalog.QUERIES["bad_lines"](spark, sf)
    assert rows.count() > 0 and len(rows.inputFiles()) > 4  # a file a bucket before


def test_patches_are_read_into_lines_once(spark, sf):
    made = plan(catalog.QUERIES["applied_patches"](spark, sf))
    assert made.count("posexplode(") == 2  # the patches' lines and the files'; the patches' twice before


def test_pairs_are_given_back_in_small_batches():
    lines = pa.array([["a", "b"], ["x"]] * 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), lines, pa.array([["a", "c"], ["x"]] * 500)], ["k", "before", "after"])
    out = list(alignment._align(iter([batch])))
    assert [n for b in out for n in b.column("k").to_pylist()] == list(range(1000)) and max(b.num_rows for b in out) <= 64
    assert out[0].column("blocks").to_pylist()[:2] == [[{"i1": 1, "i2": 2, "j1": 1, "j2": 2}], []] and "before" not in out[0].schema.names
