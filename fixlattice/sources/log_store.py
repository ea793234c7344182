"""The append-only log: a JSON-lines source and sink with a fixed schema, and substrates to write tables to and read them back.

File order is no order in Spark: every record carries ``seq``. Reads give the schema, so nothing is inferred; a missing
path is an empty log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "seq bigint, name string, kind string, python_path string, graph_identity string, realization_level string, provenance array<string>, adapters array<string>, "
    "generated_documentation array<string>, generated_agents array<string>, generated_packages array<string>, tests array<string>, golden_history array<array<string>>, witness_id string"
)
EVIDENCE = ("adapters", "generated_documentation", "generated_agents", "generated_packages", "tests")


def append(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines."""
    records.write.mode("append").json(path)


def records(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """All records of a log; empty where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def mirror(df: DataFrame, name: str, text: str, kind: str = "function") -> DataFrame:
    """Rows of (name, text) as log records: identity is the SHA-256 of the text, functions begin at the first rung, all else at the second.

    Their seq numbers the rows of one call; ``record_log.append`` numbers records over all that is appended."""
    level = F.when(F.lit(kind) == "function", "function").otherwise("program")
    none = F.array().cast("array<string>")
    return df.select(
        F.monotonically_increasing_id().alias("seq"), F.col(name).cast("string").alias("name"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("python_path"),
        F.sha2(text, 256).alias("graph_identity"), level.alias("realization_level"), F.array(F.concat(F.lit("mirror:"), F.col(name).cast("string"))).alias("provenance"),
        *[none.alias(c) for c in EVIDENCE], F.array().cast("array<array<string>>").alias("golden_history"), F.lit(None).cast("string").alias("witness_id"),
    )


#: Formats a table can be projected to: name -> (writer, reader).
SUBSTRATES: dict[str, tuple[Callable[[DataFrame, str], None], Callable[[SparkSession, str, str], DataFrame]]] = {}


def register_substrate(name: str, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str, str], DataFrame]) -> None:
    SUBSTRATES[name] = (write, read)


#: JSON is some twelve times a table's Parquet, compressed by snappy some three times; a compressed file is read by one task.
_OPTIONS = {"json": {"compression": "snappy", "maxRecordsPerFile": 200_000}}

for _f in ("parquet", "json", "orc"):
    register_substrate(_f, lambda df, path, f=_f: df.write.mode("overwrite").format(f).options(**_OPTIONS.get(f, {})).save(path), lambda spark, path, schema, f=_f: spark.read.schema(schema).format(f).load(path))

#: Rows that a round trip has on disk at once, more or less.
SLICE_ROWS = 50_000_000


def _sums(df: DataFrame) -> list[Column]:
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return [F.count("*"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)) for h in (F.xxhash64(whole), F.xxhash64(F.lit("again"), whole))]]


def digest(df: DataFrame) -> tuple:
    """(rows, two sums of row hashes): the same for tables of the same rows, as multisets, in whatever order. One pass, combined in tasks."""
    return tuple(df.agg(*_sums(df)).first())


def _md5_sums(columns: list[str]) -> list[Column]:
    md5 = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 10), 16, 10).cast("long")
    return [F.coalesce(F.sum(h), F.lit(0)) for h in (F.shiftright(md5, 20), md5.bitwiseAND((1 << 20) - 1))]


def _put_together(sums: tuple) -> tuple[tuple, int]:
    *whole, high, low = sums
    return tuple(whole), ((high << 20) + low + (1 << 63)) % (1 << 64) - (1 << 63)


def digests(df: DataFrame, columns: list[str]) -> tuple[tuple, int]:
    """``digest``, and a digest of some columns that SQL can make, in one pass: the sum of the first 40 bits of each row's MD5.

    A long holds that sum for some 16 million rows; beyond them, where SQL's cast is an error, it is the sum modulo 2^64."""
    return _put_together(df.agg(*_sums(df), *_md5_sums(columns)).first())


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of which one table has more than the other, with side, ``left`` or ``right``: as costly as it sounds, for tables whose digests differ."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def read_back(df: DataFrame, substrate: str, path: str) -> DataFrame:
    """df written to a substrate and read from it."""
    write, read = SUBSTRATES[substrate]
    write(df, path)
    return read(df.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def _sums_back(df: DataFrame, substrate: str, path: str, rows: int, sums: list[Column]) -> tuple:
    """Sums over df as read back from a substrate, rows being its count. All of df is written, but in slices of some SLICE_ROWS rows, each deleted (at path-0, path-1, ..) before the next is written:
    what this takes of disk doesn't grow with df. Slices are cut by a hash of the row, so equal rows share one, and each reads df again."""
    n, total = max(1, -(-rows // SLICE_ROWS)), None
    at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(n))
    for k in range(n):
        try:
            found = read_back(df.where(at == k) if n > 1 else df, substrate, f"{path}-{k}").agg(*sums).first()
        finally:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}-{k}")
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)
        total = tuple(a + b for a, b in zip(total, found)) if total else tuple(found)
    return total


def digests_back(df: DataFrame, substrate: str, path: str, columns: list[str], rows: int) -> tuple[tuple, int]:
    """``digests`` of df as read back from a substrate, of which nothing is left at the end; rows: the count of df."""
    return _put_together(_sums_back(df, substrate, path, rows, _sums(df) + _md5_sums(columns)))


def preserved(df: DataFrame, substrate: str, path: str) -> bool:
    """Whether the table read back from a substrate has the same rows, as multisets: a pass over each. Maps can't be hashed; columns of maps are an error. Nothing is left of the copy."""
    wanted = digest(df)
    return wanted == _sums_back(df, substrate, path, wanted[0], _sums(df))
