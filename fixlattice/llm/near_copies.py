"""Links between texts whose sets of word shingles are alike, for near copies that lie outside SimHash's radius.

A text's set is the 32 leading bits of the XXH64 of its shingles; SKETCH least members stand for a larger one. Two
sets are alike if their Jaccard similarity is at least ``similarity``: exactly, where both are whole; else by the share of
the SKETCH least members of the union that both hold (standard error 0.025 at 0.8). Texts are compared where they meet: at the least
members of three residue classes of the hashes at a time, for each of PLACES such choices. Alike sets of 0.8 meet somewhere with probability 0.991.

Every pair that meets is judged, except where links already join the two. A place is a sorted stream in one
task; one of over HOT members is worked on in pairs of blocks, each of them a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.store import written

SIMILARITY = 0.8
SKETCH = 256
CLASSES = 16
PLACES = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (12, 13, 14), (15, 3, 7), (1, 5, 9))
#: Bins of the signature by which most unlike pairs are passed over, and standard errors that a pair may fall short there.
BINS = 128
ERRORS = 3.5
HOT = 4_096
BLOCK = 1_024
LINK = "u long, v long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_and_places(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """(sketch, meeting places) of a text's shingle hashes; no shingles: an empty sketch and no place."""
    if not len(hashes):
        return b"", []
    own = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    classes, first = np.unique(own % CLASSES, return_index=True)
    least = np.full(CLASSES, 0xFFFFFFFFFF, np.uint64)
    least[classes] = own[first]
    keys = np.arange(1, len(PLACES) + 1, dtype=np.uint64)
    for column in np.array(PLACES).T:
        keys = _mixed(keys * np.uint64(31) + least[column])
    return own[:SKETCH].tobytes(), keys.view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two ascending sketches show a Jaccard similarity of ``similarity`` or more."""
    union, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        union, counts = union[:SKETCH], counts[:SKETCH]
    return bool(np.count_nonzero(counts == 2) >= similarity * len(union))


def _signatures(sketches: list[np.ndarray]) -> np.ndarray:
    """The least member of each of BINS classes, 0 where there is none."""
    out = np.zeros((len(sketches), BINS), np.uint32)
    for i, own in enumerate(sketches):
        bins, first = np.unique((own >> np.uint32(4)) % BINS, return_index=True)
        out[i, bins] = own[first] | 1
    return out


def links_within(nodes: np.ndarray, sketches: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links among texts that meet, as pairs of their nodes."""
    n = len(nodes)
    if n == 2:
        return [(int(nodes[0]), int(nodes[1]))] if alike(*sketches, similarity) else []
    root, links = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes, sig = np.array(list(map(len, sketches))), _signatures(sketches)
    held = sig > 0
    for i in range(n):
        tops = np.fromiter(map(top, range(i + 1, n)), np.int64, n - i - 1)
        others = i + 1 + np.flatnonzero(tops != top(i))
        if not len(others):
            continue
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(small >= similarity * large) | (large >= SKETCH)]
        both = np.count_nonzero((sig[others] == sig[i]) & held[i], axis=1)
        either = np.maximum(1, np.count_nonzero(held[others] | held[i], axis=1))
        near = others[both >= (similarity - ERRORS * np.sqrt(similarity * (1 - similarity) / either)) * either]
        for j in near.tolist():
            p, q = top(i), top(j)
            if p != q and alike(sketches[i], sketches[j], similarity):
                root[max(p, q)] = min(p, q)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in column]


def _of_places(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nodes, sketches = None, [], []

        def solved() -> list[tuple[int, int]]:
            return links_within(np.array(nodes), _sets(sketches), similarity) if len(nodes) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for p, node, own in zip(*(batch.column(c).to_pylist() for c in ("place", "node", "sketch"))):
                if p != place:
                    out += solved()
                    place, nodes, sketches = p, [], []
                nodes.append(node)
                sketches.append(own)
            if out:
                yield _batch(out)
        yield _batch(solved())

    return run


def _of_blocks(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, other in zip(batch.column("mine").to_pylist(), batch.column("other").to_pylist()):
                own = {m["node"]: m["sketch"] for m in (*mine, *other)}
                yield _batch(links_within(np.array(list(own)), _sets(own.values()), similarity))

    return run


def links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): links between rows of texts (node, copy, sketch, places), a written table; rows of one copy count once, by their least node.

    Links of one place span what that place joins. Empty table, or texts that never meet: no links.
    """
    spark = texts.sparkSession
    met = texts.select("node", "copy", F.explode("places").alias("place")).groupBy("place", "copy").agg(F.min("node").alias("node"))
    met = written(met.select("place", "node"), "near-places", narrow=True)
    sizes = met.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(met.join(sizes, "place").select("place", "n", "node"), "near-shared", narrow=True)
    placed = shared.join(texts.select("node", "sketch"), "node")
    cold = placed.where(F.col("n") <= HOT).select("place", "node", "sketch")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = cold.repartition(parts, "place").sortWithinPartitions("place", "node").mapInArrow(_of_places(similarity), LINK)
    many = placed.where(F.col("n") > HOT)
    if not shared.where(F.col("n") > HOT).isEmpty():
        many = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        blocks = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).groupBy("place", "blocks", "block").agg(F.collect_list(F.struct("node", "sketch")).alias("mine"))
        blocks = written(blocks, "near-blocks")  # about BLOCK texts a row
        mine = blocks.withColumn("with", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
        pairs = mine.join(blocks.select("place", F.col("block").alias("with"), F.col("mine").alias("other")), ["place", "with"])
        out = out.union(pairs.select("mine", "other").mapInArrow(_of_blocks(similarity), LINK))
    return out
