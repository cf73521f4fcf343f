"""Line rules held as data; compiled into one projection of literal patterns (no join, compiled once)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rule_id, severity, pattern (no look-around, so that every regex engine agrees).
DOCUMENT_RULES = (
    ("SEC-ASSIGN", "high", r"(password|passwd|secret|token|api_key|apikey)[\"']? *[:=]"),
    ("PII-EMAIL", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("LIC-LINE", "low", r"([Ll]icen[sc]e|[Cc]opyright)"),
    ("NUM-RUN", "low", r"[0-9]{9}"),
)


def line_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=DOCUMENT_RULES) -> DataFrame:
    """id, line (from 1), content, rule_id, severity: a row for each rule that a line breaks; narrow, no shuffle."""
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in rules)))
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "content"))
    return lines.select(id_col, (F.col("line") + 1).cast("long").alias("line"), "content", F.explode(hits).alias("hit")).select(id_col, "line", "content", "hit.*")


def flagged_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=DOCUMENT_RULES) -> DataFrame:
    """docs with flagged: whether any rule hits any line; patterns don't cross lines, so no explode is needed."""
    return docs.withColumn("flagged", F.coalesce(F.col(text_col).rlike("|".join(p for _, _, p in rules)), F.lit(False)))
