"""Importance resampling towards a target distribution, by array-scored weights and a merge of sorted runs.

Features are the runs of one to three consecutive words, hashed into ``buckets``. Every task counts the buckets of its texts in one
array; the arrays are added by Spark. A bucket's gain is the logarithm of how much more frequent it is among the target's texts
than among all, and a document's weight is the sum of the gains of its features, looked up in the array of gains. A Gumbel number made of the document's id
is added, so that the highest scores are a draw without replacement in proportion to exp(weight).

Each task writes its rows as a run, sorted by (score downwards, id upwards). Sampled splitters cut the order in ranges, measured by
one count each; prefix sums tell each range's first rank and in which range the draw ends. Only rows of ranges up to that one are dealt out, a
range to a task: it merges the pieces of the runs that reach it with a tournament tree of losers, gives ranks from the range's first one on, and stops
when the draw is full. Splitters are taken twice, over all eligible rows and over those that can be drawn, so a range's size doesn't depend on the part that is drawn;
rows whose key is the same but for their number are told apart by it, so no range is hot.

CRC-32 of runs of words is put together from the CRCs of their words: appending n bytes is a linear map of the CRC before them, looked up
in tables.

Null text: no words. Documents of fewer than ``least_words`` words have a weight and a score, and no rank. Null ids: the empty string is hashed for them, and they come last among ties.
Repeated rows are documents of their own, with equal scores and ranks that follow one another. Very long texts are read whole. Extra columns, whatever their names, are ignored.
An empty table gives no rows; an empty target has no features, and a gain then tells only how rare a bucket is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.ranges import count_where, even_slot, range_partitions, weighted_splitters
from fixlattice.llm.store import written
from fixlattice.llm.text import Memo, slices

BUCKETS = 10_000
LEAST_WORDS = 20
#: The part of the eligible documents that is drawn, in percent.
PERCENT = 5
SEED = "42"
LONGEST_RUN = 3
#: Ranges of the first, coarse cut.
COARSE = 1024
#: Bytes of a row that is merged, in memory.
_ROW_BYTES = 256

# a word is a run of digits, letters a-z and all bytes of characters beyond ASCII; anything else separates
_WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (chr(b).isalnum() or b >= 0x80) else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def _zero_byte_tables(n: int) -> np.ndarray:
    """uint32[n, 4, 256]: for 0 to n - 1 zero bytes appended, what each byte of a CRC-32 becomes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((n, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for k in range(1, n):
        out[k] = (out[k - 1] >> 8) ^ one[out[k - 1] & 255]
    return out


class RunBuckets:
    """Buckets of all runs of 1 to LONGEST_RUN words."""

    SHORT = 48

    def __init__(self, buckets: int):
        self.buckets, self.tables = buckets, _zero_byte_tables(self.SHORT + 1).ravel()
        # of a word: its CRC, and that of a space and the word
        self.memo = Memo(lambda w: zlib.crc32(w) | zlib.crc32(b" " + w) << 32)

    def _appended(self, crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """CRCs after so many zero bytes each, without the conditioning at either end."""
        left = zeros
        while True:
            step = np.minimum(left, self.SHORT)
            at = step * 1024
            t = self.tables
            crc = t[at + (crc & 255)] ^ t[at + 256 + (crc >> 8 & 255)] ^ t[at + 512 + (crc >> 16 & 255)] ^ t[at + 768 + (crc >> 24)]
            left = left - step
            if not left.any():
                return crc

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(words of each text, for each length of run: (bucket of the run that ends at each word, whether it lies in one text))."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        words = [w for t in texts for w in t]
        n = len(words)
        packed = np.fromiter(map(self.memo.__getitem__, words), np.uint64, n)
        alone, after = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32), (packed >> np.uint64(32)).astype(np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        first = np.repeat(np.cumsum(counts) - counts, counts)
        place = np.arange(n) - first
        out, crc = [(alone % self.buckets, np.ones(n, bool))], alone
        for k in range(1, LONGEST_RUN):
            grown = np.zeros(n, np.uint32)
            if n > 1:
                grown[1:] = self._appended(crc[:-1], lengths[1:]) ^ after[1:]
            crc = grown
            out.append((crc % self.buckets, place >= k))
        return counts, out


def _batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, [words_of(t) if t else [] for t in part.column("text").to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = RunBuckets(buckets), np.zeros(buckets, np.int64)
        for _, texts in _batches_of_words(batches):
            for bucket, whole in made(texts)[1]:
                total += np.bincount(bucket[whole], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(everything: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's part of the target to its part of everything)."""
    b = len(everything)
    s, t = float(everything.sum()) + b, float(target.sum()) + b
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(everything, target)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each row; row numbers are unique once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, row = RunBuckets(len(gain)), TaskContext.get().partitionId() << 33
        for part, texts in _batches_of_words(batches):
            counts, features = made(texts)
            each = np.zeros(int(counts.sum()), np.int64)
            for bucket, whole in features:
                each += np.where(whole, gain[bucket], 0)
            ends = np.concatenate([[0], np.cumsum(each)])
            to = np.cumsum(counts)
            n = sum(np.maximum(counts - k, 0) for k in range(LONGEST_RUN))
            rows = pa.array(np.arange(row, row + len(counts)))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([rows, part.column("doc_id"), pa.array(counts), pa.array(n), pa.array(ends[to] - ends[to - counts])], names=["row", "doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u of (0, 1) made of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def _place() -> Column:
    """A string that orders rows by score downwards, id upwards with nulls last, row."""
    least = F.lit(-(1 << 63)).cast("long")

    def digits(x: Column) -> Column:
        return F.lpad(F.hex(x.bitwiseXOR(least)), 16, "0")

    return F.concat(digits(F.bitwise_not("score")), F.coalesce(digits(F.col("doc_id")), F.lit("Z" * 16)), F.lpad(F.hex("row"), 16, "0"))


def _range(place: Column, bounds: list[str]) -> Column:
    held = F.split(F.lit(",".join(bounds)), ",")
    return count_where(len(bounds), lambda i: F.get(held, i) <= place)


def _measured(rows: DataFrame, bounds: list[str]) -> list[int]:
    """How many rows each range has."""
    out = [0] * (len(bounds) + 1)
    for r in rows.groupBy(_range(F.col("place"), bounds).alias("range")).agg(F.count("*").alias("n")).collect():
        out[r.range] = r.n
    return out


def ascending_runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """The (start, stop) of the longest ascending runs that an array is made of."""
    if not len(keys):
        return []
    cuts = [0, *(np.flatnonzero(keys[1:] < keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:]))


def tournament(keys: np.ndarray, runs: list[tuple[int, int]]) -> Iterator[int]:
    """The positions of all keys in ascending order, by a tree of losers over ascending runs. Ties: the earlier run."""
    k = len(runs)
    heads = [a for a, _ in runs]
    # keys of what each run offers; a run that has ended offers None, which loses to any key
    offer = [keys[a] for a in heads]

    def beats(i: int, j: int) -> bool:
        a, b = offer[i], offer[j]
        return a is not None and (b is None or a < b or (a == b and i < j))

    losers, winners = [0] * k, [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    best = winners[1] if k > 1 else 0
    while k and offer[best] is not None:
        yield heads[best]
        heads[best] += 1
        offer[best] = keys[heads[best]] if heads[best] < runs[best][1] else None
        node = (k + best) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _merge(bases: list[int], draw: int):
    """Ranks of each range's rows: bases has the rows before each range, draw is where ranks end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        at = table.column("range").to_numpy()
        for r in np.unique(at):
            own = table.filter(pa.array(at == r)).combine_chunks()
            keys = np.array(own.column("place").to_pylist(), "S48")
            rank, wanted = np.zeros(len(keys), np.int64), max(0, draw - bases[r])
            if wanted:
                for n, i in enumerate(tournament(keys, ascending_runs(keys)), 1):
                    rank[i] = bases[r] + n
                    if n == wanted:
                        break
            for batch in own.drop_columns(["range", "place"]).append_column("rank", pa.array(rank, mask=rank == 0)).to_batches(max_chunksize=10_000):
                yield batch

    return run


def draw_highest(scored: DataFrame, draw: int) -> DataFrame:
    """scored, a written table (row, doc_id, score, eligible, place, ...), with the rank of the ``draw`` highest scores of eligible rows; place is dropped."""
    spark = scored.sparkSession
    out = [c for c in scored.columns if c != "place"]
    none = scored.select(*out, F.lit(None).cast("long").alias("rank"))
    able = scored.where("eligible")
    n = able.count()
    draw = min(draw, n)
    if draw <= 0:
        return none
    one = able.select("place", F.lit(1).alias("one"))
    bounds = weighted_splitters(one, "place", "one", min(COARSE, n), n)
    before, last = 0, 0
    for last, size in enumerate(_measured(one, bounds)):
        if before + size >= draw:
            break
        before += size
    reach = bounds[last] if last < len(bounds) else None
    within = one.where(F.col("place") < reach) if reach is not None else one
    m = n if reach is None else before + size
    fine = weighted_splitters(within, "place", "one", range_partitions(spark, m * _ROW_BYTES), m)
    bases, sizes = [0], _measured(within, fine)
    for size in sizes:
        bases.append(bases[-1] + size)
    # the ranges that have a rank to give, and where they end
    parts = sum(b < draw for b in bases[:-1])
    edge = fine[parts - 1] if parts <= len(fine) else reach
    drawable = F.col("eligible") if edge is None else F.col("eligible") & (F.col("place") < edge)
    ranged = scored.where(drawable).withColumn("range", _range(F.col("place"), fine))
    dealt = ranged.repartition(parts, even_slot(spark, F.col("range"), parts)) if parts > 1 else ranged.coalesce(1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema if f.name != "place") + ", rank long"
    ranked = dealt.select(*out, "place", "range").mapInArrow(_merge(bases, draw), schema)
    return scored.where(~drawable).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: rank 1, 2, ... for those drawn, floor(percent * N / 100) of N with least_words words."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = weights(docs, gain, text).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    # each task's rows are a sorted run
    runs = written(scored.drop("n_words").withColumn("place", _place()).sortWithinPartitions("place"), "resampling-runs")
    n = runs.where("eligible").count()
    return draw_highest(runs, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")
