"""SimHash near-duplicates by pivot distance tables.

Fingerprint: words are runs of bytes other than space and 0x09-0x0D with A-Z
lower-cased; every shingle of ``words`` of them, repeats included, is hashed by
XXH64 (seed 42); a bit is set if it is set in over half the hashes. Fewer words:
the whole sequence is the one shingle; none: fingerprint zero.

Links join distinct fingerprints at ``most`` or fewer differing bits. The search:

1. The 64 bits are cut into bands, and REFERENCES reference fingerprints are drawn by a hash. A fingerprint's
   distances to them, counted within a band, are its coordinates there. By the triangle inequality coordinates of two fingerprints in a band
   differ by at most their distance in it, so with ``most`` differing bits all coordinates agree in at least len(bands) - most bands: the
   coordinates of every such choice of bands are a meeting place. More fingerprints get more and longer
   choices (``bands_for``), so that places stay small; links are the same for any bands.
2. Where they meet, distances to PIVOTS references over all 64 bits are compared, for every pair: one whose
   largest coordinate difference exceeds ``most`` can't be a link and is discarded.
3. Survivors are verified by their true distance.

A meeting place is read as a sorted stream: what its members link is kept as a
spanning forest, never as all pairs. One with more than HOT members is worked on in
blocks of members, each pair of blocks a task's work of its own, so the members of no place wait for one task.

Null and blank texts: fingerprint zero, linked like any other. Very long texts are read whole. Ties (a bit set in
exactly half the hashes) leave the bit unset. Repeated rows are one node. Extra columns, whatever their names, are carried along by
``keep_one`` and ignored by ``near_duplicates``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm import near_copies
from fixlattice.llm.components import components
from fixlattice.llm.store import free_names, result, scratch, with_fields, written
from fixlattice.llm.text import release, slices, words_of

SHINGLE_WORDS = 4
MOST_BITS = 4
#: References of each band's table, and of the table over all 64 bits.
REFERENCES = 8
PIVOTS = 24
#: Members of a meeting place beyond which it is worked on in blocks of BLOCK.
HOT = 16_384
BLOCK = 4_096


def bands_for(n: int, most: int = MOST_BITS) -> tuple[int, ...]:
    """Widths of bands such that the choices of all but ``most`` of them hold three bits more than n fingerprints need."""
    count = most + 2
    while (count - most) * 64 / count < max(1, n).bit_length() + 3 and count < 2 * most + 8:
        count += 1
    return tuple(64 // count + (k < 64 % count) for k in range(count))


def shingle_hashes(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, in order."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(shingle_words, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k:])], np.uint64)


def bits_of(h: np.ndarray) -> int:
    """The fingerprint of hashes: bits that are set in over half of them."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    return bits_of(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text: str = "text", name: str = "fp") -> DataFrame:
    """docs without its text, with the LONG whose bits are the fingerprint of the whole text (null: no words). No shuffle."""
    kept = docs.drop(name)
    names = [c for c in kept.columns if c != text]
    schema = with_fields(kept.select(*names).schema, f"`{name}` long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                fps = np.array([fingerprint(x or b"", shingle_words) for x in part.column(text).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fps.view(np.int64))], names=[*names, name])

    return kept.mapInArrow(run, schema)


def _bands(widths: tuple[int, ...]) -> list[tuple[int, int]]:
    ends = list(accumulate(widths))
    return list(zip([0, *ends[:-1]], widths))


def band_rows(fps: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The pivot table of each band: distances within the band to REFERENCES references, a byte each, as one integer a row."""
    out = []
    for low, width in _bands(widths):
        mask = np.uint64((1 << width) - 1)
        own, row = (fps >> np.uint64(low)) & mask, np.zeros(len(fps), np.uint64)
        for reference in pivots(REFERENCES):
            row = (row << np.uint64(8)) | np.bitwise_count(own ^ ((reference >> np.uint64(low)) & mask)).astype(np.uint64)
        out.append(row)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(most: int, widths: tuple[int, ...]):
    """For each fingerprint, the meeting places of all choices of len(widths) - most bands."""
    choices = list(combinations(range(len(widths)), len(widths) - most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            step = max(1, 600_000 // len(choices))
            for at in range(0, len(fps), step):
                own = fps[at : at + step]
                rows = [_mix(r ^ np.uint64((k + 1) << 58)) for k, r in enumerate(band_rows(own, widths))]
                keys = []
                for k, choice in enumerate(choices):
                    key = np.full(len(own), k, np.uint64)
                    for b in choice:
                        key = _mix(key * np.uint64(31) + rows[b])
                    keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(own, len(choices)).view(np.int64))], names=["place", "fp"])

    return run


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """One row of distances to the references for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def by_pivots(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, most: int, references: np.ndarray, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a[left], b[right]) those at ``most`` or fewer differing bits, by way of their pivot tables.

    tally: gets [pairs, left by the coordinates, links] of the call."""
    ta, tb = pivot_table(a, references), pivot_table(b, references)
    seen = len(left)
    for k in range(len(references)):
        near = np.abs(ta[left, k] - tb[right, k]) <= most
        left, right = left[near], right[near]
    held = len(left)
    near = np.bitwise_count(a[left] ^ b[right]) <= most
    if tally is not None:
        tally.append((seen, held, int(near.sum())))
    return left[near], right[near]


def linked(a: np.ndarray, b: np.ndarray, most: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a and b at ``most`` or fewer differing bits."""
    return by_pivots(a, b, np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), most, references)


class _Forest:
    """Trees over n members; a link is kept only where it joins two trees yet apart."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def tops(self, start: int, stop: int) -> np.ndarray:
        return np.fromiter(map(self.top, range(start, stop)), np.int64, stop - start)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for x, y in zip(left.tolist(), right.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.links.append((x, y))


def _within(fps: np.ndarray, most: int, references: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ascending fingerprints, block by block."""
    forest, step, n = _Forest(len(fps)), 512, len(fps)
    for i in range(0, n, step):
        for j in range(i, n, step):
            mine, other = forest.tops(i, min(i + step, n)), forest.tops(j, min(j + step, n))
            if mine[0] == other[0] and (mine == mine[0]).all() and (other == other[0]).all():
                continue  # one tree already
            left, right = linked(fps[i : i + step], fps[j : j + step], most, references)
            # of the links between two trees one is enough
            apart = np.flatnonzero((mine[left] != other[right]) & (left + i < right + j))
            _, first = np.unique(mine[left[apart]] * n + other[right[apart]], return_index=True)
            keep = apart[np.sort(first)]
            forest.add(left[keep] + i, right[keep] + j)
    return forest.links


def _links_of_places(most: int):
    references = pivots()

    def emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = (np.array(x, np.uint64).view(np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_p, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def solve(place: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            """Links within the runs of equal places."""
            edges = np.flatnonzero(np.diff(place)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(place)]])
            size = ends - starts
            out = []
            # the pairs of all places of two at once
            two = starts[size == 2]
            own, other = by_pivots(fps, fps, two, two + 1, most, references)
            out += list(zip(fps[own].tolist(), fps[other].tolist()))
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                own = fps[a:b]
                out += [(int(own[x]), int(own[y])) for x, y in _within(own, most, references)]
            return out

        for batch in batches:
            place = np.concatenate([rest_p, np.asarray(batch.column("place"))])
            fps = np.concatenate([rest_f, np.asarray(batch.column("fp")).view(np.uint64)])
            if not len(place):
                continue
            last = int(np.searchsorted(place, place[-1], side="left"))  # its run may go on
            rest_p, rest_f = place[last:], fps[last:]
            if last:
                yield emit(solve(place[:last], fps[:last]))
        if len(rest_p):
            yield emit(solve(rest_p, rest_f))

    return run


def _links_of_blocks(most: int):
    references = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, other in zip(batch.column("mine").to_pylist(), batch.column("other").to_pylist()):
                fps = np.unique(np.array([*mine, *other], np.int64).view(np.uint64))
                pairs = [(int(fps[x]), int(fps[y])) for x, y in _within(fps, most, references)]
                u, v = (np.array(x, np.uint64).view(np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(distinct: DataFrame, most: int = MOST_BITS, widths: tuple[int, ...] | None = None) -> DataFrame:
    """(u, v): links of distinct fingerprints (fp LONG) that span every component at ``most`` or fewer differing bits."""
    distinct = distinct.select("fp")
    widths = widths or bands_for(distinct.count(), most)
    if sum(widths) != 64 or len(widths) <= most:
        raise ValueError("bands must cover 64 bits and outnumber the differing bits")
    spark = distinct.sparkSession
    places = written(distinct.mapInArrow(_places(most, widths), "place long, fp long"), "places")
    met = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    hot = written(met.where(F.col("n") > HOT), "hot-places", narrow=True)
    cold = places
    if has_hot := not hot.isEmpty():
        cold = places.join(hot, "place", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cold.repartition(parts, "place").sortWithinPartitions("place", "fp").mapInArrow(_links_of_places(most), "u long, v long")
    if has_hot:
        many = places.join(hot, "place").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        blocks = (
            many.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            .groupBy("place", "blocks", "block")
            .agg(F.collect_list("fp").alias("fps"))  # about BLOCK of them
        )
        mine = blocks.withColumn("with", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
        pairs = mine.join(blocks.select("place", F.col("block").alias("with"), F.col("fps").alias("other")), ["place", "with"])
        out = out.union(pairs.select(F.col("fps").alias("mine"), "other").mapInArrow(_links_of_blocks(most), "u long, v long"))
    return out


def _least(key: str, row: str):
    """What tells nodes apart and orders them: the key, nulls last, then the row."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))


def _rooted(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, root): the least node that pairs (u, v) of fingerprints reach from each of nodes (fp, node)."""
    ends = pairs.join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    joined = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash-links")
    return nodes.join(joined.withColumnRenamed("u", "node"), "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, most: int = MOST_BITS, widths: tuple[int, ...] | None = None) -> DataFrame:
    """(key, fp, component_id) for every row of docs: its fingerprint and the least key that links reach from it.

    Rows of equal fingerprint (equal texts among them) are one node, so copies are never paired. Null keys take part
    but are no representatives unless a component has no other. Empty table: empty result.
    """
    own = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    marked = written(fingerprints(own, shingle_words), "simhash")
    nodes = written(marked.groupBy("fp").agg(F.min(_least("key", "row")).alias("node")), "simhash-nodes", narrow=True)
    classes = _rooted(nodes, links(nodes, most, widths))
    # one fingerprint may hold very many rows: the join keeps them where adaptive execution splits them
    return marked.join(classes, "fp", "left").select(F.col("key").alias(key), "fp", F.col("root.key").alias("component_id"))


def _marks(shingle_words: int):
    """Fingerprint, sketch and meeting places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, "text"):
                fps, sketches, places = [], [], []
                for x in part.column("text").cast(pa.binary()).to_pylist():
                    h = shingle_hashes(x or b"", shingle_words)
                    fps.append(bits_of(h))
                    for into, one in zip((sketches, places), near_copies.sketch_and_places(h)):
                        into.append(one)
                new = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(places, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "node", "copy")), *new], names=["key", "node", "copy", "fp", "sketch", "places"])

    return run


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = near_copies.SIMILARITY, most: int = MOST_BITS, widths: tuple[int, ...] | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least key (nulls last), then the earliest.

    Rows are linked by SimHash fingerprints at ``most`` or fewer differing bits, and, for near copies outside that
    radius, by sets of shingles whose Jaccard similarity is ``similarity`` or more (``near_copies``). Each input row gets an identity
    in a written table, so rows without a key, or of one key, are judged each on its own. Texts of no words are alike. All columns stay, whatever their names.
    """
    (row,) = free_names(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    with scratch():
        own = numbered.select(F.col(key).alias("key"), F.col(row).alias("node"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), F.col(text).alias("text"))
        schema = with_fields(own.drop("text").schema, "fp long, sketch binary, places array<long>")
        marked = written(own.mapInArrow(_marks(shingle_words), schema), "near-marks")
        nodes = written(marked.groupBy("fp").agg(F.min(_least("key", "node")).alias("node")), "near-nodes", narrow=True)
        alike = near_copies.links(marked, similarity)
        fp_of = marked.select("node", "fp")
        alike = alike.join(fp_of.select(F.col("node").alias("u"), F.col("fp").alias("a")), "u").join(fp_of.select(F.col("node").alias("v"), F.col("fp").alias("b")), "v")
        pairs = links(nodes, most, widths).union(alike.where("a <> b").select("a", "b"))
        kept = _rooted(nodes, pairs).select("fp", F.col("root.row").alias("kept"))
        gone = result(marked.select("fp", F.col("node").alias(row)).join(kept, "fp").where(F.col(row) != F.col("kept")).select(row), "near-gone", narrow=True)
    # merged at every size: what goes grows with the documents
    return numbered.hint("merge").join(gone, row, "left_anti").drop(row)
