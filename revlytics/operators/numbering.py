"""Row numbers and running sums within keys of any size.

A window over a whole key would put a hot key's rows into one task. Here the order's leading part is a
block: blocks are summed first (pre-aggregated), the sums are prefixed, and rows are only
numbered within (key, block). The block must be monotone in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a running sum, this row included, for each name of sums."""
    dealt = df.withColumns({"_block": block} | {f"_v_{n}": c for n, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.groupBy(*keys, "_block").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    base = total.select(*keys, "_block", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in sums)).join(base, [*keys, "_block"])
    return out.select(*df.columns, *((F.col(f"_b_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums))


def hash_order(seed: str, key: str) -> Column:
    """The engine's sampling order: MD5 of seed and key, in hex."""
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))


def numbered_by_hash(df: DataFrame, keys: list[str], hash_col: str, tie: str, name: str = "rn") -> DataFrame:
    """Row number from 1 within keys in the order of a hex hash (ties by another column)."""
    return running(df, keys, F.substring(F.col(hash_col), 1, 3), [F.col(hash_col), F.col(tie)], {name: F.lit(1).cast("long")})
