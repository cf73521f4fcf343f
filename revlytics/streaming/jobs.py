"""Structured Streaming forms of the keyed-state operators; on a finite source they equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str, time_col: str | None = None, late: str = "7 days") -> DataFrame:
    """Idempotent claim: the first event of each key. With a time column the state is dropped after `late`."""
    if time_col:
        return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def error_counts(stream: DataFrame, key: str, failed, time_col: str, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Samples and failures of each key and window, for an error budget; late rows are dropped after the watermark."""
    return stream.withWatermark(time_col, late).groupBy(key, F.window(time_col, every)).agg(F.count("*").alias("samples"), F.count_if(failed).alias("failures"))


def retry_plan(deliveries: DataFrame, max_attempts: int = 5) -> DataFrame:
    """action (done, dead, retry) and delay_s for rows of attempt, ok, permanent: min(2^(n-1), 10) seconds between attempts."""
    action = F.when(F.col("ok"), "done").when(F.col("permanent") | (F.col("attempt") >= max_attempts), "dead").otherwise("retry")
    delay = F.when(action == "retry", F.least(F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(10.0)))
    return deliveries.withColumns({"action": action, "delay_s": delay})
