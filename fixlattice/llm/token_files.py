"""Token ids as flat binary files with 64-bit document offsets.

One pair of files for each range of doc_id, in ascending order:

- ``part-NNNNN.bin``: the ids of the part's documents, one after another, as little-endian
  unsigned integers of 16 bits (32 where the vocabulary is larger);
- ``part-NNNNN.idx``: 8 bytes ``FXTOKENS``, then little-endian 64-bit integers: the width of an id in
  bytes, the number n of documents, n + 1 offsets in ids from the part's start, n doc_ids, n flags (1: doc_id is null).

A document's place in the whole is its part's base plus its offset. Bases are prefix sums of the
parts' lengths: a table of one row a part. Files are memory-mapped when they are read.

Null text: a document of the end id alone. Repeated rows are documents of their own, ordered by the text's hash.
Equal rows keep any order among themselves. Very long texts are encoded whole, one at a time; a part is held by its task
until it is written. Extra columns are ignored. An empty table gives no files and no rows. Files are written under another name and renamed, so a
task that is run again, or twice at once, leaves the same whole file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlattice.llm import ranges
from fixlattice.llm.store import fresh, mapped_file, write_file, written
from fixlattice.llm.text import encoder, slices, tokenizer

MAGIC = b"FXTOKENS"


def _part(folder: str, part: int) -> str:
    return f"{folder}/part-{part:05d}"


def _writer(folder: str, path: str, byte_level: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, byte_level)
        wide = enc.dtype.itemsize
        end = np.asarray([end_id], enc.dtype).tobytes()
        part, ids, sizes, doc_ids, nulls, done = None, [], [], [], [], []

        def finish() -> None:
            n = len(sizes)
            if part is None:
                return
            offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype("<i8")
            write_file(_part(folder, part) + ".bin", *ids)
            write_file(_part(folder, part) + ".idx", MAGIC, np.asarray([wide, n], "<i8").tobytes(), offsets.tobytes(), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(nulls, "<i8").tobytes())
            done.append((part, n, int(offsets[-1])))
            for x in (ids, sizes, doc_ids, nulls):
                x.clear()

        for batch in batches:
            for some in slices(batch, "text"):
                raw = map(enc.encode, some.column("text").cast(pa.binary()).to_pylist())
                for own, doc_id, coded in zip(some.column("bucket").to_pylist(), some.column("doc_id").to_pylist(), raw):
                    if own != part:
                        finish()
                        part = own
                    ids += (coded, end)
                    sizes.append(len(coded) // wide + 1)
                    doc_ids.append(doc_id or 0)
                    nulls.append(doc_id is None)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int64(), pa.int64()))], names=["part", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, byte_level: bool = True, end_id: int = 0) -> DataFrame:
    """Writes all of docs (doc_id, text) under folder; (part, n_docs, n_ids, base), one row a part.

    Texts go through one shuffle, into ranges of doc_id of nearly equal bytes (splitters from a bounded sample).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = (F.octet_length("text") + 64).cast("long")
    ids = written(docs.select("doc_id", size.alias("size")), "token-sizes")
    total = ids.agg(F.sum("size")).first()[0] or 0
    parts = ranges.range_partitions(spark, total)
    bounds = ranges.weighted_splitters(ids, "doc_id", "size", parts, total)
    bucket = ranges.count_at_or_below(F.col("doc_id"), bounds)
    dealt = docs.withColumn("bucket", bucket).withColumn("slot", ranges.even_slot(spark, F.col("bucket"), parts))
    dealt = dealt.repartition(parts, "slot").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))
    return with_bases(dealt.select("bucket", "doc_id", "text").mapInArrow(_writer(folder, path, byte_level, end_id), "part int, n_docs long, n_ids long"))


def with_bases(made: DataFrame) -> DataFrame:
    """Writes the parts and adds each one's base: the ids of all parts before it. One row a part: the driver sums them."""
    rows = sorted(made.collect(), key=lambda r: r.part)
    base, out = 0, []
    for r in rows:
        out.append((r.part, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return made.sparkSession.createDataFrame(out, "part int, n_docs long, n_ids long, base long")


def open_part(stem: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids, nulls) of one part, memory-mapped. stem: path without .bin or .idx."""
    index = mapped_file(stem + ".idx")
    if bytes(index[:8]) != MAGIC:
        raise ValueError(f"{stem}.idx is no index of token files")
    wide, n = (int(x) for x in index[8:24].view("<i8"))
    numbers = index[24:].view("<i8")
    return mapped_file(stem + ".bin").view(f"<u{wide}"), numbers[: n + 1], numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 : 3 * n + 1]


def read_token_files(parts: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of ``parts``, as they are read back."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                flat, offsets, doc_ids, nulls = open_part(_part(folder, part))
                for at in range(0, len(doc_ids), 2048):
                    to = min(at + 2048, len(doc_ids))
                    own = [np.asarray(flat[offsets[i] : offsets[i + 1]], "<u4") for i in range(at, to)]
                    cols = [
                        pa.array(np.asarray(doc_ids[at:to]), pa.int64(), mask=np.asarray(nulls[at:to], bool)),
                        pa.array(np.asarray(offsets[at:to]) + base),
                        pa.array(np.diff(offsets[at : to + 1])),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    if ids:
                        cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    spread = parts.select("part", "base").repartition(max(1, parts.count()), "part")
    return spread.mapInArrow(run, schema)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return fresh(spark, "token-files")


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size()
