"""Language-model scores by prediction by partial matching.

Null text: empty, its end alone is scored. Repeated rows are scored alike. Very long texts are read whole, in slices of their own.
Ties don't occur: a score is a sum. Extra columns are ignored. An empty table gives no rows.

A text's bytes (A-Z lower-cased), closed by the byte 0xFF that no UTF-8 text holds, are predicted one by one
from the ``order`` bytes before (0xFF before the start). The trie of contexts is
held as counts of (context, byte) for every length of context; below the longest, a byte counts once for each longer context that
it follows (update exclusion). In the longest context that training has seen, of T counts and
d different bytes, a byte of count n has probability (2n - 1) / 2T and the escape d / 2T (escape method D). After an
escape the next shorter context is read with the bytes of the longer one left out (symbol exclusion); bytes that no context
predicts share what is left alike. A context with nothing new to offer is passed over at no cost.

Two ways to accumulate the code length of a document: ``pretrained`` reads the counts that all training documents
left, ``adaptive`` starts from none and counts each document's own bytes as it goes (``adaptive_bits``).

Counts of the longest contexts are gathered in one pass over all training documents (combined in each task, then
by key); the shorter ones follow from them. The trie is built by tasks, in shards of about SHARD_ENTRIES
entries, cut by the last two bytes of the context, which all its longer contexts share. Shards are files in the shared folder that
scoring tasks map into memory one after another: a worker's memory is bounded, nothing is pruned, and a larger trie
is more shards to consult for each slice of texts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.store import fresh, mapped_file, write_file, written
from fixlattice.llm.text import Memo, slices

ORDER = 5
SHARD_ENTRIES = 2_000_000
END = 0xFF
#: Words whose counts are given to tasks; the counts of all others are joined.
FREQUENT_WORDS = 100_000
#: Distinct keys that a task gathers before it hands on what it has.
HELD = 600_000

_word_key = Memo(lambda w: xxhash.xxh64_intdigest(w) & 0x7FFFFFFFFFFFFFFF)
#: Key of the end token of a document; words' keys are non-negative.
END_KEY = -1


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every position as one integer, first position of each text), texts lower-cased already."""
    pad = bytes([END]) * order
    flat = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\xff")]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = len(flat) - order
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(order + 1):
        out <<= np.uint64(8)
        out |= flat[j : j + n]
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
    valid = np.ones(n, bool)
    for k in range(order):  # windows that end in the padding of the next text
        at = starts[1:] - 1 - k
        valid[at[at >= 0]] = False
    return out[valid], np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Tally:
    """Counts of 64-bit keys, combined as they come."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > 3 * HELD:
            self.combine()

    def combine(self) -> None:
        if len(self.parts) > 1:
            keys, which = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([c for _, c in self.parts])).astype(np.int64)
            self.parts = [(keys, counts)]
        self.held = sum(len(k) for k, _ in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.combine()
        out = self.parts[0] if self.parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.parts, self.held = [], 0
        return out


class Table:
    """A mapping from 64-bit keys (none 0) to their positions, open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slots = np.zeros(size, np.uint64)
        self.at = np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._first(keys)
        while len(left):
            free = self.slots[slot] == 0
            # of several keys that want one free slot, the last written has it
            self.at[slot[free]] = left[free]
            won = free & (self.at[slot] == left)
            self.slots[slot[won]] = keys[left[won]]
            left, slot = left[~won], slot[~won]
            slot = (slot + (self.slots[slot] != 0)) & (size - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        slot = self._first(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.at[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot_left = (slot[left] + 1) & (len(self.slots) - 1)
            slot[left] = slot_left
            held = self.slots[slot_left]
            hit = held == keys[left]
            out[left[hit]] = self.at[slot_left[hit]]
            left = left[~hit & (held != 0)]
        return out


def _tagged(keys: np.ndarray, length: int) -> np.ndarray:
    return keys | np.uint64((length + 1) << 56)


class Trie:
    """Code lengths (log10) from counts of the longest (context, byte)."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None, order: int = ORDER):
        """short: for (one byte, byte) the longer contexts over the whole corpus, where top holds only a shard of it."""
        self.order = order
        level = {order: (top, counts.astype(np.float64))}
        for k in range(order - 1, -1, -1):
            keys, _ = level[k + 1]
            if k == 1 and short is not None:
                level[1] = (short[0], short[1].astype(np.float64))
                continue
            keys, which = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            level[k] = (keys, np.bincount(which, minlength=len(keys)).astype(np.float64))
        gram_keys, log_n, alone, node_keys, esc, down, room = [], [], [], [], [], [], []
        below = None
        for k in range(order + 1):
            keys, n = level[k]
            nodes, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else np.empty(0)
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            own = np.repeat(np.arange(len(nodes)), np.diff(np.append(first, len(keys))))
            gram_keys.append(_tagged(keys, k))
            log_n.append(np.log10(n - 0.5))
            alone.append(np.log10((n - 0.5) / total[own]))
            node_keys.append(_tagged(nodes, k))
            esc.append(np.log10(0.5 * kinds / total))
            if k:
                b_keys, b_n, b_nodes, b_total, b_kinds = below
                same = np.searchsorted(b_keys, keys & np.uint64((1 << 8 * k) - 1))
                out_n = np.add.reduceat(b_n[same], first) if len(n) else np.empty(0)
                suffix = np.searchsorted(b_nodes, nodes & np.uint64((1 << 8 * (k - 1)) - 1))
                new = b_kinds[suffix] - kinds
                rest = b_total[suffix] - out_n
                some = new > 0
                down.append(np.log10(np.where(some, 0.5 * new, 1) / np.where(some, rest, 1)))
                room.append(np.log10(np.where(some, rest, 1)))
            else:
                down.append(np.zeros(len(nodes)))
                room.append(np.zeros(len(nodes)))
            below = (keys, n, nodes, total, kinds)
        self.last = -math.log10(max(1, 256 - len(level[0][0])))
        self.gram_keys, self.node_keys = np.concatenate(gram_keys), np.concatenate(node_keys)
        self.log_n, self.alone = (np.concatenate(x).astype(np.float32) for x in (log_n, alone))
        self.esc, self.down, self.room = (np.concatenate(x).astype(np.float32) for x in (esc, down, room))
        self.tables = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def costs(self, positions: np.ndarray) -> np.ndarray:
        """log10 probability of the byte at each position, given its context."""
        if self.tables is None:
            self.tables = Table(self.gram_keys), Table(self.node_keys)
        gram_table, node_table = self.tables
        out = np.zeros(len(positions), np.float32)
        left, prev = np.arange(len(positions)), None
        for k in range(self.order, -1, -1):
            own = positions if k == self.order else positions[left]
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            found = gram_table.find(_tagged(own & mask, k))
            hit = found >= 0
            if prev is None:
                out[hit] = self.alone[found[hit]]
            else:
                came = prev[hit] >= 0
                out[left[hit]] += np.where(came, self.log_n[found[hit]] - self.room[prev[hit]], self.alone[found[hit]])
            miss = ~hit
            left, own = left[miss], own[miss]
            if not len(left):
                return out
            node = node_table.find(_tagged((own & mask) >> np.uint64(8), k))
            seen = node >= 0
            if prev is None:
                out[left[seen]] = self.esc[node[seen]]
            else:
                prev = prev[miss]
                came = prev >= 0
                out[left[came]] += self.down[prev[came]]
                fresh = seen & ~came
                out[left[fresh]] += self.esc[node[fresh]]
            prev = node
        out[left] += np.float32(self.last)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        if not texts:
            return np.empty(0)
        positions, starts = grams([t.lower() for t in texts], self.order)
        return np.add.reduceat(self.costs(positions).astype(np.float64), starts)


def save_trie(path: str, trie: Trie) -> None:
    """The trie's arrays and lookup tables as one flat file."""
    tables = Table(trie.gram_keys), Table(trie.node_keys)
    arrays = {k: getattr(trie, k) for k in ("log_n", "alone", "esc", "down", "room")}
    arrays |= {f"{name}_{k}": getattr(t, k) for name, t in zip(("gram", "node"), tables) for k in ("slots", "at")}
    head = json.dumps({"order": trie.order, "last": trie.last, "bits": [t.bits for t in tables], "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}).encode()
    head += b" " * (-len(head) % 8)
    chunks = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        chunks += [a.tobytes(), bytes(-a.nbytes % 8)]
    write_file(path, *chunks)


def load_trie(path: str) -> Trie:
    raw = mapped_file(path)
    size = int(raw[:8].view("<i8")[0])
    head = json.loads(bytes(raw[8 : 8 + size]))
    at, arrays = 8 + size, {}
    for name, dtype, n in head["arrays"]:
        width = np.dtype(dtype).itemsize * n
        arrays[name] = raw[at : at + width].view(dtype)
        at += width + -width % 8
    trie = Trie.__new__(Trie)
    trie.order, trie.last = head["order"], head["last"]
    for k in ("log_n", "alone", "esc", "down", "room"):
        setattr(trie, k, arrays[k])
    tables = []
    for name, bits in zip(("gram", "node"), head["bits"]):
        t = Table.__new__(Table)
        t.bits, t.slots, t.at = bits, arrays[f"{name}_slots"], arrays[f"{name}_at"]
        tables.append(t)
    trie.tables = tuple(tables)
    return trie


GRAM, WORD = 0, 1


def _gather(order: int):
    """(kind, key, n): counts of the longest contexts with their bytes, and of words, combined within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {GRAM: Tally(), WORD: Tally()}

        def out(kind: int) -> pa.RecordBatch:
            keys, counts = tallies[kind].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                raw = [x.lower() for x in part.column("text").cast(pa.binary()).to_pylist()]
                tallies[GRAM].add(grams(raw, order)[0])
                words = [w for x in raw for w in x.split()]
                keys = np.fromiter(map(_word_key.__getitem__, words), np.uint64, len(words))
                tallies[WORD].add(keys)
                tallies[WORD].add(np.array([END_KEY], np.int64).view(np.uint64), np.array([len(raw)]))
                for kind, tally in tallies.items():
                    if tally.held > 2 * HELD:
                        tally.combine()
                        if tally.held > HELD:
                            yield out(kind)
        for kind in tallies:
            yield out(kind)

    return run


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n) over all rows of docs (text): the corpus counts, as a written table."""
    return written(docs.select("text").mapInArrow(_gather(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


def build_tries(counts: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> tuple[list[str], np.ndarray]:
    """(paths of the shards, shard of each pair of last context bytes); no path where there are no counts.

    The driver sees at most 65,536 group sizes and as many counts of byte pairs.
    """
    grams_ = counts.where(F.col("kind") == GRAM).select("key", "n")
    pair = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF).cast("int")
    groups = sorted(grams_.groupBy(pair.alias("pair")).count().collect())
    if not groups:
        return [], np.zeros(1 << 16, np.int32)
    short_rows = sorted(grams_.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("k")).agg(F.count_distinct(F.col("key").bitwiseAND(0xFFFFFF)).alias("n")).collect())
    short = np.array([r.k for r in short_rows], np.uint64), np.array([r.n for r in short_rows], np.int64)
    shard_of, shard, held = np.zeros(1 << 16, np.int32), 0, 0
    for key, n in groups:
        if held and held + n > shard_entries:
            shard, held = shard + 1, 0
        shard_of[key] = shard
        held += n
    folder = fresh(counts.sparkSession, "ppm-trie")

    def build(table: pa.Table) -> pa.Table:
        own = table.sort_by("key")
        trie = Trie(np.asarray(own["key"]).view(np.uint64), np.asarray(own["n"]), short, order)
        number = own["shard"][0].as_py()
        save_trie(f"{folder}/{number}", trie)
        return pa.table({"shard": pa.array([number], pa.int32())})

    mapping = counts.sparkSession.createDataFrame([(int(k), int(shard_of[k])) for k, _ in groups], "pair int, shard int")
    sharded = grams_.withColumn("pair", pair).join(F.broadcast(mapping), "pair").select("shard", "key", "n")
    built = sharded.groupBy("shard").applyInArrow(build, "shard int").collect()
    assert len(built) == shard + 1
    return [f"{folder}/{k}" for k in range(shard + 1)], shard_of


_open_trie: dict[str, Trie] = {}


def _opened(path: str) -> Trie:
    if path not in _open_trie:
        _open_trie.clear()
        _open_trie[path] = load_trie(path)
    return _open_trie[path]


def score_texts(texts: list[bytes], paths: list[str], shard_of: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of each text by the shards of a trie; without training every byte is as likely as any."""
    positions, starts = grams([t.lower() for t in texts], order)
    if not paths:
        cost = np.full(len(positions), -math.log10(256))
    elif len(paths) == 1:
        cost = _opened(paths[0]).costs(positions)
    else:
        cost = np.zeros(len(positions))
        of = shard_of[((positions >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
        for k in np.unique(of):
            own = np.flatnonzero(of == k)
            cost[own] = _opened(paths[k]).costs(positions[own])
    return np.add.reduceat(cost.astype(np.float64), starts)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, rare array<struct<key:long,tf:long>>"


def _scorer(paths: list[str], shard_of: np.ndarray, order: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = frequent.value  # ascending
        logs = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        rare_type = pa.list_(pa.struct([("key", pa.int64()), ("tf", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [x.lower() for x in part.column("text").cast(pa.binary()).to_pylist()]
                cols: dict[str, list] = {k: [] for k in ("n_tokens", "known", "part")}
                rare_keys, rare_tf, offsets = [], [], [0]
                for x in raw:
                    words = x.split()
                    own = np.append(np.fromiter(map(_word_key.__getitem__, words), np.int64, len(words)), END_KEY)
                    own, tf = np.unique(own, return_counts=True)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1) if len(keys) else np.zeros(len(own), np.int64)
                    hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                    cols["n_tokens"].append(len(words) + 1)
                    cols["known"].append(int(tf[hit].sum()))
                    cols["part"].append(float((tf[hit] * logs[at[hit]]).sum()))
                    rare_keys.append(own[~hit])
                    rare_tf.append(tf[~hit])
                    offsets.append(offsets[-1] + len(rare_tf[-1]))
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(np.concatenate(rare_keys)), pa.array(np.concatenate(rare_tf))], names=["key", "tf"]))
                n = len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("held_out"), pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["known"], pa.int64()), pa.array(cols["part"], pa.float64()), pa.array(score_texts(raw, paths, shard_of, order)), rare.cast(rare_type)],
                    names=[x.split()[0] for x in ("row", "doc_id", "held_out", "n_tokens", "known", "part", "score", "rare")],
                )
                row += n

    return run


def score_documents(docs: DataFrame, held_out: Column, order: int = ORDER, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Scores every row of docs (doc_id, text) by a trie and by word counts that all rows but the held-out ones left.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Null text counts as empty: its end alone is
    scored. A null held-out mark counts as false. With no training rows every byte is as likely as any and no token is known.
    Words are told apart by 63 bits of XXH64.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = train(own.where("not held_out"), order)
    paths, shard_of = build_tries(counts, order, shard_entries)
    words = counts.where(F.col("kind") == WORD)
    sizes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    total, kinds = sum(r.n for r in sizes), sum(r.v for r in sizes)
    least, among = 62, 0  # the lowest power of two such that few enough words are as frequent
    for r in sorted(sizes, reverse=True):
        if among + r.v > FREQUENT_WORDS:
            break
        least, among = r["size"], among + r.v
    top = words.where(F.col("n") >= 1 << least).select("key", "n").toArrow().sort_by("key") if among else pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    frequent = spark.sparkContext.broadcast((top["key"].to_numpy(), top["n"].to_numpy()))
    scored = written(own.mapInArrow(_scorer(paths, shard_of, order, frequent), _SCORED), "ppm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.tf")
    found = rare.join(words.where(F.col("n") < (1 << least)).select("key", "n"), "key")
    more = found.groupBy("row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_part"))
    none = F.lit(math.log10(total + kinds + 1))
    return scored.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more_part", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"),
        "score",
    )


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """Code length in bits of one text by a trie that starts empty and counts as it goes (for short texts: a step costs microseconds)."""
    seen: dict[bytes, dict[int, int]] = {}
    past, bits = bytes([END]) * order, 0.0
    for byte in text.lower() + b"\xff":
        out: set[int] = set()
        found = 0
        for k in range(order, -1, -1):
            fresh = {s: n for s, n in seen.get(past[len(past) - k :], {}).items() if s not in out}
            if not fresh:
                continue
            total = 2 * sum(fresh.values())
            if byte in fresh:
                bits -= math.log2((2 * fresh[byte] - 1) / total)
                found = k
                break
            bits -= math.log2(len(fresh) / total)
            out |= fresh.keys()
        else:
            bits += math.log2(256 - len(out))
        for k in range(found, order + 1):
            node = seen.setdefault(past[len(past) - k :], {})
            node[byte] = node.get(byte, 0) + 1
        past = (past + bytes([byte]))[1:] if order else b""
    return bits
