"""The product lattice level x 2^7 x 2^6 on bitmasks: order, join, closure step, chain and distance as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlattice.functions.dims import ALL_COOLING, ALL_RITES, LADDER, RITES, TOP_LEVEL

STATES = len(LADDER) * (ALL_COOLING + 1) * (ALL_RITES + 1)


def all_states(spark: SparkSession) -> DataFrame:
    """(level, w, r) of every state."""
    i = F.col("id")
    n = (ALL_COOLING + 1) * (ALL_RITES + 1)
    return spark.range(STATES).select(F.floor(i / n).cast("int").alias("level"), (F.floor(i / (ALL_RITES + 1)) % (ALL_COOLING + 1)).cast("bigint").alias("w"), (i % (ALL_RITES + 1)).alias("r"))


def leq(a: Column, b: Column) -> Column:
    """Order of two state structs (level, w, r)."""
    return (a["level"] <= b["level"]) & (a["w"].bitwiseAND(F.bitwise_not(b["w"])) == 0) & (a["r"].bitwiseAND(F.bitwise_not(b["r"])) == 0)


_BITS = 13


def state_index(level: Column, w: Column, r: Column) -> Column:
    """A number for each state: level, then w, then r."""
    return (level.cast("int") * (1 << _BITS) + w.cast("int") * (ALL_RITES + 1) + r.cast("int")).cast("int")


def count_above(states: DataFrame, n: str = "n") -> DataFrame:
    """(index, n_above) of every state of the lattice: the sum of n over the states (level, w, r, n) that it is leq to.

    A zeta transform: for each of the 13 bits a state without it takes over the sum of the one with it, and levels the sums of those above, in
    doubling steps. 17 passes over an array of all states, of which there are 81,920 whatever the table; states are counted before in their tasks.
    """
    spark = states.sparkSession
    counted = states.groupBy(state_index(F.col("level"), F.col("w"), F.col("r")).alias("index")).agg(F.sum(n).alias("n"))
    every = spark.range(STATES).select(F.col("id").cast("int").alias("index")).join(counted, "index", "left").select("index", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    sums = every.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "n"))), lambda x: x["n"]).alias("f"))
    bits = F.array(*[F.lit(1 << k) for k in range(_BITS)])
    levels = F.array(*[F.lit(1 << _BITS + k) for k in range(TOP_LEVEL.bit_length())])
    # the array of sums goes through the steps as the state of a fold
    below = F.aggregate(bits, F.col("f"), lambda f, bit: F.transform(f, lambda x, i: x + F.when(i.bitwiseAND(bit) == 0, F.get(f, i + bit)).otherwise(0)))
    sums = sums.select(F.aggregate(levels, below, lambda f, step: F.transform(f, lambda x, i: x + F.coalesce(F.get(f, i + step), F.lit(0)))).alias("f"))
    return sums.select(F.posexplode("f").alias("index", "n_above"))


def lub() -> list[Column]:
    """Aggregates for the join of the states (level, w, r) of a group; an empty group gives the bottom."""
    return [F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.bit_or("w"), F.lit(0)).alias("w"), F.coalesce(F.bit_or("r"), F.lit(0)).alias("r")]


def _lowest_missing(mask: Column) -> Column:
    return F.bitwise_not(mask).bitwiseAND(mask + 1)


def closure_step(level: Column, w: Column, r: Column) -> tuple[Column, Column, Column]:
    """First missing step, else first missing rite, else the next rung; the top is its own."""
    cool, rite = w < ALL_COOLING, r < ALL_RITES
    return (
        F.when(cool | rite, level).otherwise(F.least(level + 1, F.lit(TOP_LEVEL))).cast("int"),
        F.when(cool, w.bitwiseOR(_lowest_missing(w))).otherwise(w),
        F.when(~cool & rite, r.bitwiseOR(_lowest_missing(r))).otherwise(r),
    )


def distance(level: Column, w: Column, r: Column) -> Column:
    """Steps to the top: what is missing, counted."""
    return (TOP_LEVEL - level + 7 - F.bit_count(w) + len(RITES) - F.bit_count(r)).cast("int")


def _filled(mask: Column, bits: Column, width: int) -> Column:
    """The mask with its ``bits`` lowest missing bits set."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), mask, lambda m, i: F.when(i < bits, m.bitwiseOR(_lowest_missing(m))).otherwise(m))


def chain(states: DataFrame) -> DataFrame:
    """states (with level, w, r) exploded to their chains up to the top: step 0 is the state itself. Closed form, no loop."""
    total = distance(F.col("level"), F.col("w"), F.col("r"))
    cool = F.lit(7) - F.bit_count("w")
    rite = F.lit(len(RITES)) - F.bit_count("r")
    out = states.withColumn("step", F.explode(F.sequence(F.lit(0), total)))
    at_w = _filled(F.col("w"), F.least(F.col("step"), cool), 7)
    at_r = _filled(F.col("r"), F.least(F.greatest(F.col("step") - cool, F.lit(0)), rite), 6)
    at_level = (F.col("level") + F.greatest(F.col("step") - cool - rite, F.lit(0))).cast("int")
    made = out.select(*[c for c in out.columns if c not in ("level", "w", "r")], at_level.alias("_level"), at_w.cast("bigint").alias("_w"), at_r.cast("bigint").alias("_r"))
    return made.withColumnsRenamed({"_level": "level", "_w": "w", "_r": "r"})


def next_closure(level: Column, w: Column, r: Column) -> tuple[Column, Column]:
    """(kind, name) of the next closure; kind fixpoint has no name."""
    from fixlattice.functions.dims import COOLING, nth

    cool, rite = w < ALL_COOLING, r < ALL_RITES

    def first(mask: Column, names: list[str]) -> Column:
        return nth(names, F.bit_count(_lowest_missing(mask) - 1))

    kind = F.when(cool, "cooling").when(rite, "rite").when(level < TOP_LEVEL, "rung").otherwise("fixpoint")
    name = F.when(cool, first(w, COOLING)).when(rite, first(r, RITES)).when(level < TOP_LEVEL, nth(LADDER, level + 1))
    return kind, name
