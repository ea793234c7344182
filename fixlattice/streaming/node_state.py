"""What a log shows of each name, kept in keyed state as records arrive: evidence, rites and position without a second look at the log.

The state of a name is a few values: counts of node records and external witnesses, the last node record's fields that rites are
judged by, up to two identities, the steps cooled. They merge in any order (greatest seq, sums, unions), so records may arrive late or out of order. Before the shuffle each
task merges its records by name, so that a name with most of the records is a few rows there. A name that records touched gives a row in the batch; its
greatest ``n_records`` is the present one.

Without an event time this is a streaming aggregation. With one, a processor of our own (``NodeState``) holds the state: a timer of each name runs out ``idle`` after its latest record, once the watermark
has passed; the name then gives a row with ``idle`` true. The state stays: evidence doesn't expire. A name costs calls between Python and the state there, so its rows are merged once more after the shuffle. Null names are a name of their own. State lives in RocksDB, and with the checkpoint folder of the query survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fixlattice.operators.log import cooled_steps, is_external

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "n_records long, n_nodes long, last_seq long, level_name string, has_docs boolean, has_tests boolean, has_packages boolean, has_identity boolean, identities array<string>, tested boolean, cooled long, n_external long"
_FIELDS = [c.split(" ")[0] for c in _STATE.split(", ")]
_OF_LAST = ("last_seq", "level_name", "has_docs", "has_tests", "has_packages", "has_identity")
#: Identities that decide whether a name has more than one.
_IDENTITIES = 2
#: Rows that a task holds to merge them by name, and rows of a batch it gives.
MERGED_ROWS, OUT_ROWS = 200_000, 10_000


def merged(a: dict, b: dict) -> dict:
    """The state of two sets of records together."""
    later = b if (b["last_seq"] is not None and (a["last_seq"] is None or b["last_seq"] > a["last_seq"])) else a
    out = {k: a[k] + b[k] for k in ("n_records", "n_nodes", "n_external")} | {k: later[k] for k in _OF_LAST}
    return out | {"identities": sorted({*a["identities"], *b["identities"]})[:_IDENTITIES], "tested": a["tested"] or b["tested"], "cooled": a["cooled"] | b["cooled"]}


def _each(log: DataFrame, time: str | None) -> DataFrame:
    """Each record as the state of itself alone."""
    node = F.col("kind") != "witness"
    passes = F.flatten(F.coalesce("golden_history", F.array().cast("array<array<string>>")))
    some = lambda c: F.when(node, F.coalesce(F.size(c) > 0, F.lit(False)))
    named = F.coalesce(F.col("graph_identity") != "", F.lit(False))
    none = F.array().cast("array<string>")
    return log.select(
        "name",
        *([F.col(time).cast("timestamp").alias("time")] if time else []),
        F.lit(1).cast("long").alias("n_records"),
        F.when(node, 1).otherwise(0).cast("long").alias("n_nodes"),
        F.when(node, F.col("seq")).alias("last_seq"),
        F.when(node, F.col("realization_level")).alias("level_name"),
        some("generated_documentation").alias("has_docs"),
        some("tests").alias("has_tests"),
        some("generated_packages").alias("has_packages"),
        F.when(node, named).alias("has_identity"),
        F.when(node & named, F.array("graph_identity")).otherwise(none).alias("identities"),
        F.coalesce(node & F.array_contains(passes, "testing"), F.lit(False)).alias("tested"),
        F.when(node, cooled_steps(passes)).otherwise(0).cast("long").alias("cooled"),
        F.when((F.col("kind") == "witness") & is_external(F.col("witness_id")), 1).otherwise(0).cast("long").alias("n_external"),
    )


def _combined(rows: pa.Table) -> pa.Table:
    """``merged`` over the rows of each name, for all names at once."""
    if not rows.num_rows:
        return rows
    names = pc.dictionary_encode(rows["name"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    seq = rows["last_seq"]
    # by name, then seq, records without one first: the last row of a name is its last node record
    order = np.lexsort((pc.fill_null(seq, 0).to_numpy(), seq.is_valid().to_numpy(), names))
    sorted_names = names[order]
    starts = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
    last = pa.array(order[np.r_[starts[1:], len(order)] - 1])

    def over(how: np.ufunc, c: pa.ChunkedArray) -> np.ndarray:
        return how.reduceat(c.to_numpy()[order], starts)

    out = {c: rows[c].take(last) for c in ("name", *_OF_LAST)}
    out |= {c: over(np.add, rows[c]) for c in ("n_records", "n_nodes", "n_external")}
    out |= {"cooled": over(np.bitwise_or, rows["cooled"]), "tested": over(np.logical_or, rows["tested"]), "identities": _least_identities(rows["identities"].combine_chunks(), names, sorted_names[starts])}
    if "time" in rows.column_names:
        times = rows["time"].cast(pa.int64())
        none = np.iinfo(np.int64).min
        latest = over(np.maximum, pc.fill_null(times, none))
        out["time"] = pa.array(latest, mask=latest == none).cast(rows.schema.field("time").type)
    return pa.table([pa.array(out[f.name], f.type) if isinstance(out[f.name], np.ndarray) else out[f.name] for f in rows.schema], schema=rows.schema)


def _least_identities(lists: pa.Array, names: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """The _IDENTITIES least of each name among the lists of its rows, for the names in the order wanted (ascending)."""
    words = lists.flatten().dictionary_encode()
    ranks = np.empty(len(words.dictionary), np.int64)
    by_rank = pc.sort_indices(words.dictionary).to_numpy()
    ranks[by_rank] = np.arange(len(by_rank))
    pairs = np.unique(names[lists.value_parent_indices().to_numpy()].astype(np.int64) * max(1, len(ranks)) + ranks[words.indices.to_numpy()])
    owner, rank = pairs // max(1, len(ranks)), pairs % max(1, len(ranks))
    kept = np.ones(len(owner), bool)
    kept[_IDENTITIES:] = owner[_IDENTITIES:] != owner[:-_IDENTITIES]
    owner, rank = owner[kept], rank[kept]
    offsets = np.r_[np.searchsorted(owner, wanted), len(owner)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.dictionary.take(pa.array(by_rank[rank])))


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows merged by name, some MERGED_ROWS held at most: once a name where a task's names are fewer than half of that, else some names more often."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= MERGED_ROWS:
            held = [_combined(pa.concat_tables(held))]
            if held[0].num_rows > MERGED_ROWS // 2:
                yield from held.pop().to_batches(OUT_ROWS)
    if held:
        yield from _combined(pa.concat_tables(held)).to_batches(OUT_ROWS)


class NodeState(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("evidence", _STATE)
        self.until = handle.getValueState("until", "at long")

    def _row(self, key, held: dict, idle: bool) -> Row:
        return Row(name=key[0], **{k: held[k] for k in _FIELDS}, idle=idle)

    def _held(self) -> dict | None:
        held = self.state.get()
        return None if held is None else dict(zip(_FIELDS, held))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, latest = self._held(), None
        for r in rows:
            new = {k: r[k] for k in _FIELDS}
            held = new if held is None else merged(held, new)
            if r["time"] is not None:
                latest = max(latest or 0, int(r["time"].timestamp() * 1000))
        if held is None:
            return
        held["identities"] = list(held["identities"])
        self.state.update(tuple(held[k] for k in _FIELDS))
        if latest is not None:
            until = latest + self.idle_ms
            before = self.until.get()[0] if self.until.exists() else None
            if before is None or until > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.until.update((until,))
                self.handle.registerTimer(until)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        if held is not None:
            self.until.clear()
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def _aggregated(each: DataFrame) -> DataFrame:
    """The states of names as a streaming aggregation: what ``merged`` does, in the engine, merged in tasks before the shuffle and then with the state."""
    identity = F.element_at("identities", 1)
    found = each.withColumn("identity", F.when(F.size("identities") > 0, identity)).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("n_records", "n_nodes", "n_external")],
        F.max_by(F.struct(*_OF_LAST), "last_seq").alias("last"),
        F.min("identity").alias("least"),
        F.max("identity").alias("greatest"),
        F.bool_or("tested").alias("tested"),
        F.bit_or("cooled").alias("cooled"),
    )
    # identities beyond the second decide nothing: the least and the greatest tell whether there are two
    some, two = F.col("least").isNotNull(), F.col("least") != F.col("greatest")
    found = found.withColumn("identities", F.when(two, F.array("least", "greatest")).when(some, F.array("least")).otherwise(F.array().cast("array<string>")))
    return found.select("name", *[F.col(f"last.{c}" if c in _OF_LAST else c).alias(c) for c in _FIELDS], F.lit(False).alias("idle"))


def evidence_stream(log: DataFrame, time: str | None = None, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The evidence of every name that a batch touches, as a stream with the columns of ``operators.log.evidence`` but provenance, n_records and idle; to be written in update mode.

    time: a column of the log by which names become idle; records may be ``late`` by so much before the watermark passes them, and count even then.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    each = _each(log, time)
    if time is None:
        out = _aggregated(each)
    else:
        combined = each.mapInArrow(_merge_batches, each.schema).repartition("name").mapInArrow(_merge_batches, each.schema)
        # a merged row has the latest time of those merged into it
        combined = combined.withWatermark("time", late)
        idle_ms = int(spark.sql(f"SELECT CAST(to_unix_timestamp(timestamp'1970-01-02 00:00:00' + INTERVAL '{idle}') - to_unix_timestamp(timestamp'1970-01-02 00:00:00') AS BIGINT)").first()[0]) * 1000
        out = combined.groupBy("name").transformWithState(NodeState(idle_ms), f"name string, {_STATE}, idle boolean", "Update", "EventTime")
    # names of witnesses only have no last record
    shown = {c: F.coalesce(c, F.lit(False)) for c in _OF_LAST if c.startswith("has_")}
    return out.withColumns(shown | {"n_identities": F.size("identities").cast("long")}).drop("identities", "last_seq")
