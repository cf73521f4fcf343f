"""Append-only logs read as tables: latest, first and merged row of each key, by pre-aggregated max_by/min_by (no window, so hot keys do no harm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(log: DataFrame, keys: list[str], seq: list[str], last: bool) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    by = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*seq))
    return log.groupBy(*keys).agg(by.alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def latest(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Last write wins; seq must order a key's rows totally."""
    return _pick(log, keys, seq, True)


def first(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """First write wins (insert or ignore)."""
    return _pick(log, keys, seq, False)


def immutable(log: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, n_rows, n_contents, conflict: a key written with different contents."""
    return log.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(content).alias("n_contents")).withColumn("conflict", F.col("n_contents") > 1)
