"""Secrets: patterns, and how many owners and repositories hold each value, by corpus-wide ownership frequency.

Whole texts are searched once. Three patterns give base spans: values assigned to a telling name, access keys, long runs of lower-case
hex digits. Beside them every run of ``TOKEN`` characters outside base spans is a candidate. Of each value a hash goes on, never the
value. Hashes are aggregated over the corpus: rows, distinct repositories and distinct owners that hold them. A value of
``wide_owners`` owners or more is an ``example``, copied from documentation to documentation. One of ``own_owners`` owners at most is
owner-specific, and ``live`` if it looks like a credential: letters and digits in turn, with ``LEAST_BITS`` bits of entropy a character
(``looks_live``). All others are ``unclear``. A candidate that is live is a span of kind ``live``; base spans stay, with their verdict.

Counts are combined in tasks, then by (value, owner, repository), (value, owner) and value, so that a value that a third
of all rows hold is three small sums. Verdicts go back to the spans by value: values with more than 1 / ``HEAVY`` of all occurrences, of which there are
fewer than ``HEAVY``, are broadcast; all others are joined, and none of them holds more than that part of the rows.

Null text: empty. Null owners count as one owner, null repositories as one repository of it. Repeated rows and equal texts are documents of
their own and are found alike; they add rows, not owners, unless their owners differ. A value that occurs often in one text counts once for it. Ties: a value
with exactly ``wide_owners`` owners is an example, one with exactly ``own_owners`` owner-specific. Very long texts are read whole. Extra columns, whatever
their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.llm.store import written
from fixlattice.llm.text import slices

KINDS = ("assign", "access", "hex", "live")
#: Owners from which on a value is a copied example, and up to which it is specific to its owner.
WIDE_OWNERS = 5
OWN_OWNERS = 2
#: Bits of entropy a character that a credential has at least.
LEAST_BITS = 3.0
#: Values with more than this part of all occurrences are broadcast.
HEAVY = 4096

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
# maximal runs: a shorter one is passed over as a whole
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("value", pa.binary()), ("looks", pa.bool_())])
_FOUND = "row long, doc_id long, owner string, repository string, found array<struct<start:long,rank:int,stop:long,value:binary,looks:boolean>>"


def looks_live(value: str) -> bool:
    """Letters and digits that alternate (one change in eight characters at least) with LEAST_BITS bits of entropy a character."""
    kinds = [c.isdigit() for c in value if c.isalnum()]
    if sum(a != b for a, b in zip(kinds, kinds[1:])) * 8 < len(value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of KINDS, stop, value) of every base span and candidate of a text, by start, then rank; places in code points."""
    base = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    base += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base.sort()
    more, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            more.append((m.start(), 3, m.end(), m[0]))
    return sorted(base + more) if more else base


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch, "text"):
            found = []
            for text in part.column("text").to_pylist():
                spans = spans_of(text) if text else []
                found.append([{"start": a, "rank": r, "stop": b, "value": hashlib.sha256(v.encode()).digest()[:16], "looks": looks_live(v)} for a, r, b, v in spans])
            rows = pa.array(range(row, row + part.num_rows), pa.int64())
            row += part.num_rows
            columns = [part.column(c) for c in ("doc_id", "owner", "repository")]
            yield pa.RecordBatch.from_arrays([rows, *columns, pa.array(found, pa.list_(_SPAN))], names=["row", "doc_id", "owner", "repository", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_docs, n_repositories, n_owners) of found (owner, repository, found)."""
    held = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda s: s["value"]))).alias("value"))
    held = held.groupBy("value", "owner", "repository").agg(F.count("*").alias("n_docs"))
    held = held.groupBy("value", "owner").agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_repositories"))
    return held.groupBy("value").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def _with_owners(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """spans (value, ...) with what owned has of their values; few values of any frequency, or any number of rare ones, meet in a task."""
    total = spans.count()
    heavy = owned.where(F.col("n_docs") * HEAVY > total)
    common = spans.join(F.broadcast(heavy), "value")
    rare = spans.join(F.broadcast(heavy.select("value")), "value", "left_anti").join(owned, "value")
    return common.unionByName(rare)


def scan(docs: DataFrame, text: str = "text", owner: Column | str = "source", repository: Column | str | None = None, wide_owners: int = WIDE_OWNERS, own_owners: int = OWN_OWNERS) -> DataFrame:
    """(doc_id, spans) of each row of docs; spans: array<struct<start, rank, stop, verdict, n_owners, n_repositories, n_docs>>, by start, then rank of KINDS.

    owner, repository: columns or expressions; without a repository an owner's rows are one.
    """
    own = F.col(owner) if isinstance(owner, str) else owner
    repo = F.lit("") if repository is None else F.col(repository) if isinstance(repository, str) else repository
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.cast("string").alias("owner"), repo.cast("string").alias("repository"), F.col(text).alias("text"))
    found = written(plain.mapInArrow(_search, _FOUND), "secret-candidates")
    holding = found.where(F.size("found") > 0)
    owned = written(ownership(holding), "secret-owners", narrow=True)
    spans = holding.select("row", F.explode("found").alias("s")).select("row", "s.value", "s.start", "s.rank", "s.stop", "s.looks")
    told = _with_owners(spans, owned)
    verdict = F.when(F.col("n_owners") >= wide_owners, "example").when((F.col("n_owners") <= own_owners) & F.col("looks"), "live").otherwise("unclear")
    told = told.withColumn("verdict", verdict).where((F.col("rank") < 3) | (F.col("verdict") == "live"))
    each = F.struct("start", "rank", "stop", "verdict", "n_owners", "n_repositories", "n_docs")
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    with_spans = holding.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return found.where(F.size("found") == 0).select("doc_id", none.alias("spans")).unionByName(with_spans)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of ``scan`` as counts, a hash of the base spans and all spans as text."""
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")

    def count(holds: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("spans", holds)).cast("long")

    def of(rank: int) -> Column:
        return count(lambda s: s["rank"] == rank)

    return scanned.select(
        "doc_id",
        *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(lambda s: (s["rank"] < 3) & (s["verdict"] == "live")).alias("n_base_live"),
        count(lambda s: (s["rank"] < 3) & (s["verdict"] == "example")).alias("n_base_example"),
    )
