"""Best-fit packing in a hierarchy of residual bins.

Documents are encoded, closed by an end id and cut only where they exceed the capacity. Each
partition of the written pieces packs its own by best fit, longest first. Bins that
are nearly full, or can't help any other, are sequences at once; the rest are items for
further best-fit rounds, each over the bins of FAN partitions, up to a single node.

What goes up is bounded: after best fit two bins of one node never fit together, so at most one of
them is at most half full. Two bins over half full never fit together either, so a
round can only put a half-empty bin into a host. All half-empty bins go up (one a
partition at most), with as many hosts, those with most room, as there are partitions.

Null text: the end id alone. Repeated rows are documents of their own. Ties: of bins with equal room the one filled
last is taken, of equal sizes the earlier. Very long texts are encoded whole and cut into pieces of the capacity. Extra columns are
ignored by ``pack_documents`` and carried along by ``pack``. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fixlattice.llm.store import with_fields, written
from fixlattice.llm.text import encoder, slices

CAPACITY = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A bin with less room than this is a sequence as it is.
NEARLY_FULL = 8
FAN = 8


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size and the fill of each bin: longest first, into the fullest bin that has room."""
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), []
    room: dict[int, list[int]] = {}
    free = 0  # bit f: some bin has f free
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        if over := free >> size:
            f = size + (over & -over).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                free &= ~(1 << f)
        else:
            b = len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        if left := capacity - used[b]:
            room.setdefault(left, []).append(b)
            free |= 1 << left
    return bin_of, offset, used


def _pieces(path: str, byte_level: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, byte_level)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            raw = [enc.encode(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), raw):
                ids = np.append(np.frombuffer(coded, enc.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, path: str, byte_level: bool, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of docs (doc_id, text). No shuffle."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_pieces(path, byte_level, end_id, capacity), PIECE)


def _local(capacity: int, before=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition: every piece with its bin and offset; ``used`` on one piece of each bin."""
        node = TaskContext.get().partitionId()
        held = list(before(batches) if before else batches)
        if not held:
            return
        sizes = [x for b in held for x in b.column("length").to_pylist()]
        bins, offsets, used = best_fit(sizes, capacity)
        told: set[int] = set()
        at = 0
        for b in held:
            own = bins[at : at + b.num_rows]
            fill = []
            for k in own:
                fill.append(None if k in told else used[k])
                told.add(k)
            cols = [pa.array(np.asarray(own, np.int64) + (node << 33)), pa.array(offsets[at : at + b.num_rows], pa.int64()), pa.array([node] * b.num_rows, pa.int32()), pa.array(fill, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "bin", "at", "node", "used"])
            at += b.num_rows

    return run


def _going_up(used: np.ndarray, hosts: int, capacity: int) -> np.ndarray:
    """Which bins of a node can still save a sequence further up."""
    half = used <= capacity // 2
    host = np.flatnonzero(~half & (capacity - used >= NEARLY_FULL))
    up = half.copy()
    up[host[np.argsort(used[host], kind="stable")[:hosts]]] = True
    return up


def _round(capacity: int, hosts: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        """One node: where each of its bins goes, and whether that bin goes up."""
        items = items.sort_values(["used", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, used = best_fit(items["used"].tolist(), capacity)
        first: dict[int, int] = {}
        for b, name in zip(bins, items["bin"].tolist()):
            first.setdefault(b, name)
        up = _going_up(np.asarray(used, np.int64), hosts, capacity)
        return pd.DataFrame({"bin": items["bin"].to_numpy(), "to": [first[b] for b in bins], "by": offsets, "node": items["parent"].to_numpy(), "used": [used[b] for b in bins], "up": [bool(up[b]) for b in bins]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with ``length``) with sequence_id and offset."""
    return _pack(pieces, pieces.schema, None, capacity)


def _pack(df: DataFrame, schema: StructType, before, capacity: int) -> DataFrame:
    """The pieces of the schema that ``before`` (None: nothing) makes of a partition's batches, packed."""
    names = schema.names
    placed = written(df.mapInArrow(_local(capacity, before), with_fields(schema, "bin long, at long, node int, used long")), "packed-locally")
    bins = placed.where("used is not null").select("node", "bin", "used")
    nodes = (placed.agg(F.max("node")).first()[0] or 0) + 1
    smallest = F.col("used") <= capacity // 2
    ranked = bins.where(F.col("used") <= capacity - NEARLY_FULL).withColumn("rank", F.row_number().over(_window("node", smallest)))
    items = ranked.where(smallest | (F.col("rank") <= nodes)).select("node", "bin", "used")
    moves = None
    while nodes > 1:
        nodes = -(-nodes // FAN)
        grouped = items.withColumn("parent", (F.col("node") / FAN).cast("int"))
        done = written(grouped.groupBy("parent").applyInPandas(_round(capacity, max(nodes * FAN, FAN)), "bin long, to long, by long, node int, used long, up boolean"), "packed-round", narrow=True)
        step = done.select("bin", "to", "by")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("to"), F.col("to").alias("_to"), F.col("by").alias("_by"))
            moves = moves.join(later, "to", "left").select("bin", F.coalesce("_to", "to").alias("to"), (F.col("by") + F.coalesce("_by", F.lit(0))).alias("by"))
        items = done.where("up and bin = to").select("node", "bin", "used")
    out = [F.col(c) for c in names]
    if moves is None:
        return placed.select(*out, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moves = moves.where("bin <> to or by <> 0")
    return placed.join(moves, "bin", "left").select(*out, F.coalesce("to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("offset"))


def _window(node: str, smallest):
    from pyspark.sql import Window

    return Window.partitionBy(node, smallest).orderBy("used", "bin")


def pack_documents(docs: DataFrame, path: str, byte_level: bool = False, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs."""
    # cut and packed locally in one pass: a partition's pieces are a few numbers each
    return _pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), StructType.fromDDL(PIECE), _pieces(path, byte_level, end_id, capacity), capacity)
