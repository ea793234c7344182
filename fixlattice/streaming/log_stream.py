"""The log as a stream: records from files, each once, and the latest record of every name kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixlattice.operators.log import latest
from fixlattice.sources.log_store import LOG_SCHEMA


def log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """New log files as they come, as a stream with the log's schema."""
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each key in tumbling windows; rows later than ``late`` are dropped and windows closed by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, time: str, late: str = "1 day", keys: tuple[str, ...] = ("name", "seq")) -> DataFrame:
    """Each record once; state is bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def keep_latest(stream: DataFrame, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Maintains (at table_path/<version>) the latest record of every name; a batch that is run again writes the same version.

    A version is the one before it merged with the latest records of the batch.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, version: int) -> None:
        new = latest(batch)
        if version:
            old = spark.read.schema(batch.schema).parquet(f"{table_path}/{version - 1}")
            new = latest(old.unionByName(new.select(*old.columns)))
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{table_path}/{version}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
