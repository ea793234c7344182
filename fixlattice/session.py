"""One place for session settings; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str | None = None, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fixlattice")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition of ``dealt``, for work that costs up to a millisecond a row or makes some KB of it.
DEALT_ROWS = 20_000


def dealt(df: DataFrame, key: str, rows: int = DEALT_ROWS) -> DataFrame:
    """df over as many partitions as its rows are worth, the session's shuffle partitions at least: a small file is one partition, whatever is made of its rows. Costs a count."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(n, key)
