"""Order over whole tables without a single task: sampled splitters, ranges, prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampled keys for each range that is to be made.
SAMPLES_PER_RANGE = 64


#: Ranges of one pass at most; beyond them ranges grow with the input, and tasks stream what a range holds.
MOST_RANGES = 1 << 16


def long_array(values: list[int]) -> Column:
    """An array<bigint> of numbers that is one constant of the plan, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def count_at_or_below(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= key (0 for a null key): a binary search in SQL functions."""
    held = long_array(bounds)
    return count_where(len(bounds), lambda i: F.get(held, i) <= key)


def count_where(n: int, below: Callable[[Column], Column]) -> Column:
    """How many of n ascending bounds hold ``below``, which no bound does after the first that doesn't."""
    if not n:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & below(at + step - 1), at + step).otherwise(at))


def weighted_sample(df: DataFrame, keys: list[str], weight: str, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` rows, each with probability min(1, wanted * weight / total), by a hash of the row's keys and weight.

    The draw depends on the row alone, so a task that is run again draws the same rows.
    """
    unit = (F.xxhash64(*keys, F.col(weight), F.lit("splitter")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    return df.where(unit < F.col(weight) * F.lit(wanted / max(1, total)))


def weighted_splitters(df: DataFrame, key: str, weight: str, ranges: int, total: int) -> list:
    """At most ranges - 1 ascending distinct key values that cut the weight of df into nearly equal parts.

    Driver memory is bounded by SAMPLES_PER_RANGE * ranges sampled keys, whatever the size of df.
    A key whose rows weigh more than a range appears once; its range stays overfull and the caller subdivides it.
    """
    if ranges < 2 or not total:
        return []
    drawn = weighted_sample(df.where(F.col(key).isNotNull()), [key], weight, total, SAMPLES_PER_RANGE * ranges)
    # a row that weighs more than one sample stands for several
    copies = F.greatest(F.lit(1), (F.col(weight) * F.lit(SAMPLES_PER_RANGE * ranges / total)).cast("long")).alias("n")
    sample = sorted((r[0], r[1]) for r in drawn.select(key, copies).collect())
    all_n = sum(n for _, n in sample)
    out, seen, nxt = [], 0, 1
    for value, n in sample:
        while nxt < ranges and seen >= nxt * all_n / ranges:
            if not out or out[-1] != value:
                out.append(value)
            nxt += 1
        seen += n
    return out


def even_slot(spark: SparkSession, bucket: Column, parts: int) -> Column:
    """A LONG column by which repartition(parts, column) sends bucket b, of parts buckets, to a partition of its own."""
    found: dict[int, int] = {}
    n = parts * 16
    while len(found) < parts:
        rows = spark.range(n).select(F.pmod(F.hash("id"), F.lit(parts)).alias("b"), "id").groupBy("b").agg(F.min("id").alias("id")).collect()
        found = {r.b: r.id for r in rows}
        n *= 4
    return F.get(long_array([found[b] for b in range(parts)]), bucket)


def range_partitions(spark: SparkSession, total_bytes: int, each: int = 24 << 20) -> int:
    """As many ranges as the session's shuffle partitions, and more, up to MOST_RANGES, where a range would exceed ``each`` bytes."""
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2, shuffled, min(MOST_RANGES, -(-int(total_bytes) // each)))
