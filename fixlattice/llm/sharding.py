"""Shards by sampled splitters. SQL functions only; the driver sees bounded samples and one row a range.

Rows are ordered by (hash of the text, hash of the key), so equal texts lie together. A size-weighted sample of text hashes gives
quantile boundaries, and records are range-partitioned by them. Ranges are then measured: one that is
overfull (many rows of one text, say) is subdivided by a second sample drawn in it, of both hashes, so that no
range needs more than its share of work; only texts that alone outweigh ``whole_group`` of a shard are divided by the second hash.
Prefix sums over the measured ranges and running sums within them give every record's exact
place in the whole, from which shards of nearly equal bytes are cut. Equal texts stay in one shard, unless together they outweigh
``whole_group`` of a shard, when their rows are cut like any others.

Null text: size 1, CRC of the empty text. Repeated rows are placed one by one; ties of both hashes are broken by the
row's number in the written table of keys. Very long texts count with their bytes. Extra columns, whatever their names, are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixlattice.llm.ranges import MOST_RANGES, SAMPLES_PER_RANGE, count_at_or_below, count_where, long_array, weighted_sample, weighted_splitters
from fixlattice.llm.store import written

SHARDS = 8
#: A range is overfull beyond so many times its share of the rows or bytes.
OVERFULL = 3
#: Equal texts are kept together up to this part of a shard.
WHOLE_GROUP = 0.05


def _second(heavy: list[int]) -> Column:
    """The second hash of rows of heavy texts; of all others the least number, so that their equal texts share a range."""
    least = F.lit(-(1 << 63))
    return F.when(F.col("k1").isin(heavy), F.col("k2")).otherwise(least) if heavy else least


def place(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", whole_group: float = WHOLE_GROUP) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row; slots of a shard are gapless from 0."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(F.col(key).alias("key"), (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.xxhash64(value).alias("k1"), F.xxhash64(F.col(key), F.lit("slot")).alias("k2"), F.monotonically_increasing_id().alias("row")),
        "shard-keys",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, n // 1_000_000))
    limit = whole_group * total / shards
    first = weighted_splitters(rows, "k1", "size", wanted, total)
    at = count_at_or_below(F.col("k1"), first)
    measured = rows.groupBy(at.alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    overfull = {r["at"]: max(r["size"] * wanted / max(1, total), r["n"] * wanted / max(1, n)) for r in measured}
    overfull = {k: share for k, share in overfull.items() if share > OVERFULL}
    second: list[tuple[int, int]] = []
    heavy: list[int] = []
    if overfull:
        within = rows.withColumn("at", at).where(F.col("at").isin(list(overfull)))
        # each holds more than whole_group of a shard: at most shards / whole_group of them
        heavy = [r["k1"] for r in within.groupBy("k1").agg(F.sum("size").alias("size")).where(F.col("size") > limit).select("k1").collect()]
        within = within.withColumn("k2", _second(heavy))
        # by rows and by bytes alike: a share of each row's weight is the same for all
        weight = within.withColumn("weight", (F.col("size") * F.lit(n) + F.lit(total)).cast("double"))
        of_all = 2.0 * n * total
        drawn = weighted_sample(weight, ["k1", "k2", "row"], "weight", of_all, SAMPLES_PER_RANGE * wanted)
        sample: dict[int, list] = {}
        for r in drawn.select("at", "k1", "k2").collect():
            sample.setdefault(r["at"], []).append((r["k1"], r["k2"]))
        for k, share in overfull.items():
            own, parts = sorted(sample.get(k, [])), int(share) + 1
            second += {own[len(own) * j // parts] for j in range(1, parts)} if own else set()
    second = sorted(set(second))
    outer, inner = long_array([a for a, _ in second]), long_array([b for _, b in second])
    sub = count_where(len(second), lambda i: (F.get(outer, i) < F.col("k1")) | ((F.get(outer, i) == F.col("k1")) & (F.get(inner, i) <= F.col("k2"))))
    ranged = rows.withColumn("cut", F.col("k1").isin(heavy) if heavy else F.lit(False)).withColumn("k2", _second(heavy)).withColumn("range", at + sub)
    sizes = sorted(ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
    bases, b, m = [], 0, 0
    for r in sizes:
        bases.append((r["range"], b, m))
        b, m = b + r["size"], m + r["n"]
    if not bases:
        return rows.select(F.col("key").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    base = spark.createDataFrame(bases, "range int, base long, base_rows long")
    own = Window.partitionBy("range")
    running = own.orderBy("k1", "k2", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = own.orderBy("k1").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = total / shards
    # one row a range: bounded by the range count
    placed = ranged.join(F.broadcast(base), "range").select(
        "*",
        F.sum("size").over(running).alias("upto"),
        F.row_number().over(own.orderBy("k1", "k2", "row")).alias("number"),
        F.sum("size").over(whole).alias("group_upto"),
        F.sum("size").over(Window.partitionBy("range", "k1")).alias("group"),
    )
    middle = F.when(~F.col("cut") & (F.col("group") <= limit), F.col("group_upto") - F.col("group") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    placed = written(
        placed.select("key", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor((F.col("base") + middle) / F.lit(share))).cast("int").alias("shard"), (F.col("base_rows") + F.col("number")).alias("number")),
        "shard-places",
    )
    firsts = placed.groupBy("shard").agg(F.min("number").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("number") - F.col("first")).cast("long").alias("slot"))
