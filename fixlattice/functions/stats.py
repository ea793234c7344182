"""Rates with Wilson intervals, as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """(lo, hi): (0, 1) for n = 0, lo exactly 0 for k = 0, hi exactly 1 for k = n; null unless 0 <= k <= n."""
    kd, nd = k.cast("double"), F.when(n > 0, n).cast("double")
    p = kd / nd
    z2 = z * z
    d = 1 + z2 / nd
    centre = (p + z2 / (2 * nd)) / d
    half = z * F.sqrt(F.greatest(p * (1 - p) / nd + z2 / (4 * nd * nd), F.lit(0.0))) / d
    valid = (k >= 0) & (k <= n)
    lo = F.when(valid, F.when((n == 0) | (k == 0), 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)))
    hi = F.when(valid, F.when((n == 0) | (k == n), 1.0).otherwise(F.least(F.lit(1.0), centre + half)))
    return lo, hi


def with_rate(df: DataFrame, k: str = "k", n: str = "n", z: float = Z) -> DataFrame:
    """Adds rate (0.0 for n = 0), lo and hi."""
    lo, hi = wilson(F.col(k), F.col(n), z)
    return df.withColumns({"rate": F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0), "lo": lo, "hi": hi})


def primary(metric: Column) -> Column:
    """The rate of a metric struct where it has one, else its value."""
    return F.coalesce(metric["rate"], metric["value"])
