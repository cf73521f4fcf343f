"""JSON-lines corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Domains of the corpus columns.
SPLITS = ("train", "validation", "holdout")
SEVERITIES = ("low", "medium", "high", "critical")
CASE = (
    "id string, repository string, pull_request int, split string, diff string, "
    "expected_findings array<struct<path:string,start_line:int,end_line:int,cwe:string,severity:string,should_comment:boolean>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSONL corpus with `problems`, an array of what is wrong with each row (empty: valid); blank lines are skipped."""
    raw = spark.read.schema(CASE + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    copies = raw.where("id is not null").groupBy("id").agg(F.count("*").alias("_n"))
    bad_range = F.exists("expected_findings", lambda e: (e["start_line"] < 1) | (e["end_line"] < e["start_line"]))
    bad_severity = F.exists("expected_findings", lambda e: ~F.lower(e["severity"]).isin(*SEVERITIES))
    checks = {
        "corrupt": F.col("_corrupt_record").isNotNull(), "no-id": F.col("id").isNull(), "duplicate-id": F.coalesce(F.col("_n") > 1, F.lit(False)),
        "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "range": F.coalesce(bad_range, F.lit(False)), "severity": F.coalesce(bad_severity, F.lit(False)),
    }
    problems = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return raw.join(copies, "id", "left").withColumn("problems", problems).drop("_n", "_corrupt_record")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in alphabetical order, nulls left out."""
    df.select(*sorted(df.columns)).write.mode("error").json(path)
