"""Ordered folds over keys of any size: a prefix scan in segments.

A window partitioned by a key puts all rows of the key into one task. Here a key that holds more than one ``ranges``-th of all rows
is hot, and its rows are cut into ranges of equal size by quantiles of their order; all other keys stay one range, 0. Rows are folded within
(key, range). What a range does to whatever comes before it is a summary of a few values; the summaries of a hot key, one a range,
are folded in order, and each range gets the state before it, the carry. A fold can be told so if its steps compose: counters (also
saturating ones), last values, bounds, running extremes.

There are fewer than ``ranges`` hot keys, with at most ``ranges`` ranges each, and both are checked: what is broadcast has at most ``ranges`` squared rows.
Rows of one key and equal order can't be cut apart. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Ranges of a key at most, whatever the session's partitions.
MOST_RANGES = 1024


@dataclass
class Segments:
    """Rows with ``_seg``, the range of their key's order. hot: (_key, _bounds) of the hot keys, None where there is none."""

    rows: DataFrame
    keys: list[str]
    order: str
    hot: DataFrame | None

    def window(self) -> WindowSpec:
        """The rows of a range in order."""
        return Window.partitionBy(*self.keys, "_seg").orderBy(self.order)

    def _of_hot(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_key", F.struct(*self.keys)).join(F.broadcast(self.hot.select("_key")), "_key", "left_semi")

    def with_carry(self, rows: DataFrame, summary: dict[str, Column], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        """rows with ``_carry``, the state before their range: ``start`` stepped over the summaries (structs of aggregates) of their key's ranges before it."""
        if self.hot is None:
            return rows.withColumn("_carry", start)
        ranges = self._of_hot(rows).groupBy("_key", "_seg").agg(F.struct(*[c.alias(n) for n, c in summary.items()]).alias("_s"))
        told = ranges.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_seg", "_s"))).alias("_l"))
        # states in order; the last one is that after the last range
        states = F.aggregate("_l", F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x["_s"]))))
        carried = told.select("_key", F.explode(F.arrays_zip(F.transform("_l", lambda x: x["_seg"]).alias("seg"), F.slice(states, 1, F.size("_l")).alias("state"))).alias("_c"))
        carried = carried.select("_key", F.col("_c.seg").alias("_seg"), F.col("_c.state").alias("_carry"))
        joined = rows.withColumn("_key", F.struct(*self.keys)).join(F.broadcast(carried), ["_key", "_seg"], "left")
        return joined.drop("_key").withColumn("_carry", F.coalesce("_carry", start))

    def with_totals(self, rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
        """rows with aggregates over all rows of their key."""
        w = Window.partitionBy(*self.keys, "_seg")
        if self.hot is None:
            return rows.withColumns({n: c.over(w) for n, c in totals.items()})
        whole = self._of_hot(rows).groupBy("_key").agg(*[c.alias(f"_hot_{n}") for n, c in totals.items()]).withColumn("_is_hot", F.lit(True))
        joined = rows.withColumns({n: c.over(w) for n, c in totals.items()}).withColumn("_key", F.struct(*self.keys)).join(F.broadcast(whole), "_key", "left")
        return joined.withColumns({n: F.when(F.col("_is_hot"), F.col(f"_hot_{n}")).otherwise(F.col(n)) for n in totals}).drop("_key", "_is_hot", *[f"_hot_{n}" for n in totals])


def _count_at_or_below(bounds: Column, value: Column) -> Column:
    """How many of an ascending array's members are <= value: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_RANGES.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value), at + step).otherwise(at))


def cut(df: DataFrame, keys: list[str], order: str, ranges: int | None = None) -> Segments:
    """df cut into segments; ``order`` is a number. ranges: as many as the session has shuffle partitions, MOST_RANGES at most."""
    spark = df.sparkSession
    n = max(2, min(MOST_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keyed = df.select(F.struct(*keys).alias("_key"), F.col(order).alias("_order"))
    total = keyed.count()
    # fewer than n keys have more than an n-th of the rows
    counted = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") * n > total).select("_key")
    hottest = counted.collect()
    if not hottest:
        return Segments(df.withColumn("_seg", F.lit(0)), keys, order, None)
    hot = spark.createDataFrame(hottest, counted.schema)
    found = keyed.join(F.broadcast(hot), "_key").groupBy("_key").agg(F.array_sort(F.array_distinct(F.percentile_approx("_order", [k / n for k in range(1, n)], 20 * n))).alias("_bounds"))
    held = found.collect()
    assert len(held) < n and all(len(r["_bounds"]) < n for r in held)
    bounds = spark.createDataFrame(held, found.schema)
    rows = df.withColumn("_key", F.struct(*keys)).join(F.broadcast(bounds), "_key", "left")
    rows = rows.withColumn("_seg", F.coalesce(_count_at_or_below(F.col("_bounds"), F.col(order)), F.lit(0))).select(*df.columns, "_seg")
    return Segments(rows, keys, order, bounds)
