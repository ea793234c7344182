"""Document fingerprints by consistent weighted sampling.

Terms of a text are its five-word shingles (A-Z lower-cased; words are runs of
bytes other than space and 0x09-0x0D), weighted by how often they occur. For each of
``samples`` independent draws a term gets r, c ~ Gamma(2, 1) and beta ~ U(0, 1)
from a hash of the term and the draw; t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta + 1); the draw's sample is the (term, t) of least a.
Two texts agree in a draw with probability sum(min(w, w')) / sum(max(w, w')), the
generalised Jaccard similarity, so the share of equal components estimates it.

Fewer than five words: the whole sequence is the only term. No words (null, empty
or blank text): no term, a signature of zeros, which equals only its like. Equal texts have equal signatures, so
repeated rows do. Ties of ln a within a draw go to the lesser name of the sample. Very long texts are read whole, a block of
terms at a time. ``fingerprints`` carries extra columns along, ``compare_with_edited`` ignores them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm import ranges
from fixlattice.llm.store import with_fields, written
from fixlattice.llm.text import Memo, slices, words_of

SAMPLES = 64
SHINGLE_WORDS = 5
_BLOCK = 256  # terms worked on at once: the arrays stay in cache

_word_hash = Memo(xxhash.xxh64_intdigest)


def _mixed(x: np.ndarray, tmp: np.ndarray, a: int, b: int) -> None:
    """A bijective mix of 64-bit integers, in place."""
    np.right_shift(x, np.uint64(30), out=tmp)
    np.bitwise_xor(x, tmp, out=x)
    np.multiply(x, np.uint64(a), out=x)
    np.right_shift(x, np.uint64(27), out=tmp)
    np.bitwise_xor(x, tmp, out=x)
    np.multiply(x, np.uint64(b), out=x)
    np.right_shift(x, np.uint64(31), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def shingle_hashes(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit hash for each shingle, in order, repeats included."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[k : n - width + 1 + k]
        out ^= out >> np.uint64(29)
    _mixed(out, np.empty_like(out), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
    return out


def _mixed32(x: np.ndarray, tmp: np.ndarray) -> None:
    """A bijective mix of 32-bit integers, in place."""
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(by), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def _gamma2_quantile(u: np.ndarray) -> np.ndarray:
    """x with 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        # -expm1(-x) - x exp(-x) keeps small values exact
        under = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


# Quantiles of Gamma(2, 1). c is looked up by the leading bits of a 31-bit integer as a float: cells are fine
# near 0, where the least of many draws lies. r is looked up by 12 bits.
_C_LOW = 0x3F800000 >> 12
_c_cells = (np.arange(_C_LOW, (0x4F000000 >> 12) + 1, dtype=np.uint32) << np.uint32(12) | np.uint32(0x800)).view(np.float32).astype(np.float64)
_LN_C = np.log(_gamma2_quantile(np.minimum(_c_cells / 2.0**31, 1 - 2.0**-32))).astype(np.float32)
_R = _gamma2_quantile((np.arange(4096) + 0.5) / 4096).astype(np.float32)


def _draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, ...]:
    """For each term and draw: ln c, r, beta (float32) and the 32 bits that name the term in a signature."""
    seeds = np.arange(1, samples + 1, dtype=np.uint32)
    halves = terms.view(np.uint32).reshape(-1, 2)
    x = halves[:, :1] ^ (seeds * np.uint32(0x9E3779B1))
    tmp = np.empty_like(x)
    _mixed32(x, tmp)
    y = x ^ halves[:, 1:]
    y += seeds * np.uint32(0x7FEB352D)
    _mixed32(y, tmp)
    x ^= y * np.uint32(0x846CA68B)
    _mixed32(x, tmp)
    name = x ^ (y * np.uint32(0x9E3779B1))
    np.right_shift(x, np.uint32(1), out=tmp)
    np.bitwise_or(tmp, np.uint32(1), out=tmp)
    cell = tmp.view(np.int32).astype(np.float32).view(np.int32)
    cell >>= 12
    cell -= _C_LOW
    ln_c = _LN_C.take(cell)
    np.right_shift(y, np.uint32(20), out=tmp)
    r = _R.take(tmp.view(np.int32))
    np.bitwise_and(y, np.uint32(0xFFFFF), out=y)
    beta = y.view(np.int32).astype(np.float32)
    beta += np.float32(0.5)
    beta *= np.float32(2.0**-20)
    return ln_c, r, beta, name


def _packed(ln_a: np.ndarray, name: np.ndarray) -> np.ndarray:
    """ln a (which exceeds -64) and the sample's name in 64 bits that order by a."""
    ln_a += np.float32(64)
    np.maximum(ln_a, np.float32(0), out=ln_a)
    out = np.empty((*ln_a.shape, 2), np.uint32)
    out[..., 1] = ln_a.view(np.uint32)
    out[..., 0] = name
    return out.view(np.uint64)[..., 0]


def signatures(shingles: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 32-bit components for each multiset of term hashes; zeros for an empty one."""
    out = np.zeros((len(shingles), samples), np.uint32)
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
    if not sizes.sum():
        return out
    terms, which = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(len(shingles)), sizes)
    pair, weight = np.unique(owner * len(terms) + which, return_counts=True)
    owner, which = pair // len(terms), pair % len(terms)
    base = np.empty((len(terms), samples), np.uint64)
    for at in range(0, len(terms), _BLOCK):
        ln_c, r, beta, name = _draws(terms[at : at + _BLOCK], samples)
        beta -= np.float32(1)
        beta *= r
        ln_c += beta  # weight 1: t = 0
        base[at : at + _BLOCK] = _packed(ln_c, name)
    heavy = np.flatnonzero(weight > 1)
    more = {}
    for at in range(0, len(heavy), _BLOCK):
        own = heavy[at : at + _BLOCK]
        ln_c, r, beta, name = _draws(terms[which[own]], samples)
        t = np.floor(np.log(weight[own].astype(np.float32))[:, None] / r + beta)
        again = name ^ (t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1))
        more[at // _BLOCK] = _packed(ln_c - r * (t - beta + np.float32(1)), again)
    starts = np.searchsorted(owner, np.arange(len(shingles) + 1))
    at_heavy = np.searchsorted(heavy, starts)
    for i in range(len(shingles)):
        a, b = starts[i], starts[i + 1]
        if a == b:
            continue
        light = which[a:b]
        p, q = at_heavy[i], at_heavy[i + 1]
        best = None
        if p < q:
            light = light[weight[a:b] == 1]
            for k in range(p // _BLOCK, (q - 1) // _BLOCK + 1):
                part = more[k][max(p - k * _BLOCK, 0) : q - k * _BLOCK].min(axis=0)
                best = part if best is None else np.minimum(best, part)
        for k in range(0, len(light), 4096):
            part = base[light[k : k + 4096]].min(axis=0)
            best = part if best is None else np.minimum(best, part)
        out[i] = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components: the estimate of generalised Jaccard similarity."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with ``fingerprint``: the signature of each whole text as hex, 8 digits for each draw. No shuffle.

    Null text counts as empty. Every column of docs stays; one called fingerprint is replaced.
    """
    kept = docs.drop("fingerprint")
    schema = with_fields(kept.schema, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw = part.column(text).cast(pa.binary()).to_pylist()
                sig = signatures([shingle_hashes(words_of(x or b""), shingle_words) for x in raw], samples)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([as_text(s) for s in sig], pa.string())], names=[*part.schema.names, "fingerprint"])

    return kept.mapInArrow(run, schema)


_EDITED_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many of the following text (or all it has)."""
    n = len(text)
    return text[: n - n // 4] + following[: n // 4]


def _compare(samples: int, shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text) whose next document hasn't come yet
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts: dict[str, int] = {}
            for _, text, following in rows:
                for x in (text, following, edited(text, following)):
                    texts.setdefault(x, len(texts))
            sig = signatures([shingle_hashes(words_of(x.encode()), shingle_words) for x in texts], samples)
            hexed = [as_text(s) for s in sig]
            out = []
            for doc_id, text, following in rows:
                changed = edited(text, following)
                i, j, k = texts[text], texts[changed], texts[following]
                out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), hexed[i], hexed[j], likeness(sig[i], sig[j]), likeness(sig[i], sig[k])))
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [x.split()[0] for x in _EDITED_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            cols = [batch.column(c) for c in ("bucket", "ahead", "doc_id", "text")]
            for i in range(batch.num_rows):
                bucket, ahead, doc_id, text = (c[i].as_py() for c in cols)
                text = text or ""
                if held and held[0] == bucket:
                    rows.append((held[1], held[2], text))
                    size += len(held[2])
                    if size >= 1 << 19:
                        yield flush()
                        size = 0
                held = None if ahead else (bucket, doc_id, text)
        if rows:
            yield flush()

    return run


def compare_with_edited(docs: DataFrame, samples: int = SAMPLES, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """For each row (doc_id, text): its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document is the next row by (doc_id, hash of the text), nulls first; the first follows the last.
    Documents go once through a shuffle, into ranges of doc_id of nearly equal bytes (splitters from a bounded,
    size-weighted sample); each range also gets the first row of the range after it. A repeated row is followed
    by its like. An empty table gives an empty result; a single row is followed by itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    ids = written(docs.select("doc_id", "th", (F.octet_length("text") + 64).cast("long").alias("size")), "fingerprint-ids")
    total = ids.agg(F.sum("size")).first()[0] or 0
    parts = ranges.range_partitions(spark, total)
    bounds = ranges.weighted_splitters(ids, "doc_id", "size", parts, total)
    bucket = ranges.count_at_or_below(F.col("doc_id"), bounds)
    # one row for each range: at most ``parts``
    firsts = sorted(ids.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("doc_id", "th")).alias("f")).collect(), key=lambda r: r.bucket)
    before = [(r.f.doc_id, r.f.th, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
    ahead = spark.createDataFrame(before, "first_id long, first_th long, ahead_of int") if before else spark.createDataFrame([], "first_id long, first_th long, ahead_of int")
    dealt = (
        docs.withColumn("bucket", bucket)
        .join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")), "left")
        .withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ahead")), F.when(F.col("ahead_of").isNotNull(), F.struct(F.col("ahead_of").alias("bucket"), F.lit(1).alias("ahead")))))))
        .select("to.bucket", "to.ahead", "doc_id", "th", "text")
        .withColumn("slot", ranges.even_slot(spark, F.col("bucket"), parts))
    )
    dealt = dealt.repartition(parts, "slot").sortWithinPartitions("bucket", "ahead", "doc_id", "th")
    return dealt.select("bucket", "ahead", "doc_id", "text").mapInArrow(_compare(samples, shingle_words), _EDITED_SCHEMA)
