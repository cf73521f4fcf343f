"""Null-honest metrics as Columns: an empty denominator gives null, never 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def ratio(n: Column, d: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def f1_of_rounded(p: Column, r: Column) -> Column:
    """F1 from precision and recall as they are shown (rounded); null where one is null, 0 where both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / (p + r), 4))


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """A bound of the Wilson score interval, clamped to [0, 1]; null without samples."""
    m = F.when(n > 0, n.cast("double"))
    p, z2 = hits / m, Z * Z
    half = Z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    bound = (p + z2 / (2 * m) + (half if upper else -half)) / (1 + z2 / m)
    return F.when(m.isNotNull(), F.round(F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)), 4))


def at_least(candidate: Column, threshold: Column, margin: float = 0.0) -> Column:
    """A tri-state gate: null where either side is unmeasurable."""
    return candidate >= threshold + F.lit(margin)


def not_worse(candidate: Column, baseline: Column) -> Column:
    """A lower-is-better gate; unmeasurable is a failure."""
    return F.coalesce(candidate <= baseline, F.lit(False))


def non_regressing(candidate: Column, baseline: Column, margin: float = 0.0) -> Column:
    """Nothing to lose passes, a metric that became unmeasurable fails."""
    return baseline.isNull() | F.coalesce(candidate + F.lit(margin) >= baseline, F.lit(False))


def passes_all(gate: Column) -> Column:
    """Aggregate: every gate is true; null is not a pass."""
    return F.count_if(F.coalesce(gate, F.lit(False))) == F.count(F.lit(1))


def bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket of a key: the first 32 bits of its SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def interval_distance(line: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), start - line, line - end)
