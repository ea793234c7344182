"""The append-only log as a data source: ``format("record_log")``, a reader, a writer and their streams.

A log is a folder of Parquet files and of commits. A task writes its records to a file of its own, in the order it gets them; nothing is
visible then. The commit of an append lists the files in the order of the tasks and gives each the number of its first record: a record's
``seq`` is that plus its place in the file. So seq is gapless and ascending from 0 over all appends, a task that is run again or twice leaves a file that
nobody reads, and a failed append leaves nothing. Commits are numbered and created exclusively where the file system can (local
folders by link, others by a rename that must not replace): of two writers at once one finds its number taken and commits under the next.

Reads plan from the commits alone: a partition a row group of a file, those that filters on ``seq`` or ``name`` exclude not read at all. Filters reach the reader of
``records`` in sessions with ``spark.sql.python.filterPushdown.enabled``, as those of ``fixlattice.session`` are; Spark evaluates them again. As a stream, an offset is the number of
commits; every record arrives once. A stream that appends is committed once a batch: a batch that is run again is recognised by its number and ``writer``, an option naming the query.

A folder that doesn't exist is an empty log. Records without a name, with null fields, or repeated are kept as they are; a column ``seq`` that is written is ignored,
columns that the log doesn't have too, those that are missing are null. A commit that names no files is made for an empty append.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fixlattice.sources import log_store

#: Records of a log, with fields that only some kinds have as JSON in payload.
LOG_SCHEMA = f"{log_store.LOG_SCHEMA}, payload string"
_KINDS = {"bigint": LongType(), "string": StringType(), "array<string>": ArrayType(StringType()), "array<array<string>>": ArrayType(ArrayType(StringType()))}
#: LOG_SCHEMA as a type; workers of a data source have no session to parse it.
LOG_TYPE = StructType([StructField(n, _KINDS[t]) for n, t in (c.split(" ") for c in LOG_SCHEMA.split(", "))])
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Rows of a row group, the unit that is read by one task and skipped by its names.
GROUP_ROWS = 100_000


class _Folder:
    """A folder of a log, by path or URI."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
        self.root = root.rstrip("/")

    def _list(self, name: str) -> list[str]:
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{name}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file)

    def commits(self, since: int = 0, until: int | None = None) -> list[dict]:
        """Commits ``since`` to ``until`` in order."""
        out = []
        for name in self._list("commits"):
            number = int(name.split(".")[0]) if name.endswith(".json") else -1
            if number >= since and (until is None or number < until):
                with self.system.open_input_file(f"{self.root}/commits/{name}") as f:
                    out.append(json.loads(f.read()) | {"number": number})
        return out

    def count(self) -> int:
        return sum(n.endswith(".json") for n in self._list("commits"))

    def create(self, number: int, commit: dict) -> bool:
        """Whether the commit could be made under this number; False where another has it."""
        from pyarrow import fs

        target, draft = f"{self.root}/commits/{number:012d}.json", f"{self.root}/commits/draft-{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.root}/commits", recursive=True)
        with self.system.open_output_stream(draft) as f:
            f.write(json.dumps(commit).encode())
        try:
            if isinstance(self.system, fs.LocalFileSystem):
                os.link(draft, target)
                return True
            if self.system.get_file_info(target).type != fs.FileType.NotFound:
                return False
            self.system.move(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            if self.system.get_file_info(draft).is_file:
                self.system.delete_file(draft)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str | None = None
    rows: int = 0
    #: (rows, least name, greatest name, whether names are missing) of each row group
    groups: list[tuple] = field(default_factory=list)


@dataclass
class Group(InputPartition):
    file: str
    group: int
    first: int


def _conform(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def _stored(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = to_arrow_schema(schema)
    return pa.schema([f for f in whole if f.name != "seq"])


class _Writer:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        out, file, sink, schema = Written(TaskContext.get().partitionId()), f"{uuid.uuid4().hex}.parquet", None, _stored(self.schema)
        held: list[pa.RecordBatch] = []
        folder = _Folder(self.path)

        def flush() -> None:
            nonlocal sink
            table = pa.Table.from_batches(held)
            if sink is None:
                folder.system.create_dir(f"{folder.root}/data", recursive=True)
                sink = pq.ParquetWriter(f"{folder.root}/data/{file}", schema, filesystem=folder.system)
            sink.write_table(table, row_group_size=max(1, len(table)))
            names = [n for n in table.column("name").unique().to_pylist() if n is not None] if "name" in schema.names else []
            out.groups.append((len(table), min(names, default=None), max(names, default=None), "name" not in schema.names or table.column("name").null_count > 0))
            out.rows += len(table)
            held.clear()

        for batch in iterator:
            if batch.num_rows:
                held.append(_conform(batch, schema))
            if sum(b.num_rows for b in held) >= GROUP_ROWS:
                flush()
        if held:
            flush()
        if sink is not None:
            sink.close()
            out.file = file
        return out

    def _commit(self, messages: list, mark: str | None = None) -> None:
        folder = _Folder(self.path)
        held = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.partition)
        while True:
            made = folder.commits()
            if mark is not None and any(c.get("mark") == mark for c in made):
                return
            first = made[-1]["next"] if made else 0
            files = []
            for m in held:
                files.append({"file": m.file, "first": first, "groups": m.groups})
                first += m.rows
            if folder.create(made[-1]["number"] + 1 if made else 0, {"files": files, "next": first, "mark": mark}):
                return

    def _abort(self, messages: list) -> None:
        folder = _Folder(self.path)
        for m in messages:
            if m is not None and m.file:
                folder.system.delete_file(f"{folder.root}/data/{m.file}")


class LogWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class LogStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType, name: str):
        super().__init__(path, schema)
        self.name = name

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{self.name}/{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


def _groups(commits: list[dict], names: set | None = None, least: int = 0, most: int | None = None) -> list[Group]:
    """The row groups of the commits that can hold one of the names and a seq from least to most."""
    out = []
    for c in commits:
        for f in c["files"]:
            first = f["first"]
            for i, (rows, low, high, _) in enumerate(f["groups"]):
                inside = first + rows > least and (most is None or first <= most)
                if inside and (names is None or (low is not None and any(low <= n <= high for n in names))):
                    out.append(Group(f["file"], i, first))
                first += rows
    return out


def _read(path: str, schema: StructType, group: Group) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    folder, wanted = _Folder(path), to_arrow_schema(schema)
    with folder.system.open_input_file(f"{folder.root}/data/{group.file}") as f:
        source, at = pq.ParquetFile(f), group.first
        held = [x for x in wanted.names if x in source.schema_arrow.names]
        for batch in source.iter_batches(row_groups=[group.group], columns=held):
            if "seq" in wanted.names:
                batch = batch.append_column("seq", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows
            yield _conform(batch, wanted)


class LogReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.names, self.least, self.most = path, schema, None, 0, None

    def partitions(self) -> list[Group]:
        return _groups(_Folder(self.path).commits(), self.names, self.least, self.most)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition) if isinstance(partition, Group) else iter(())


class PruningReader(LogReader):
    """A reader that Spark tells its filters; sessions without filter pushdown refuse such a one."""

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "name" and isinstance(f, (EqualTo, In)):
                values = set(f.value if isinstance(f, In) else [f.value]) - {None}
                self.names = values if self.names is None else self.names & values
            elif column == "seq" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if column == "seq" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.most = top if self.most is None else min(self.most, top)
            yield f  # whole row groups are skipped; rows are Spark's to judge


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": _Folder(self.path).count()}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return _groups(_Folder(self.path).commits(start["commits"], end["commits"]))

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.schema, partition)


class RecordLog(DataSource):
    """Options: path; writer, the name under which a stream appends; pushdown, whether the session pushes filters."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a record_log needs a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> LogReader:
        return (PruningReader if self.options.get("pushdown") == "true" else LogReader)(self._path(), schema)

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a record_log is appended to, not overwritten")
        return LogWriter(self._path(), LOG_TYPE)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self._path(), LOG_TYPE, self.options.get("writer", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLog)


def append(records: DataFrame, path: str, order: str | None = None) -> None:
    """Appends records; columns that the log doesn't have are left out. order: a column in whose order they are numbered; else that of the partitions and their rows."""
    register(records.sparkSession)
    ordered = records.orderBy(order) if order else records
    kept = [c for c in LOG_TYPE.names if c != "seq" and c in records.columns]
    ordered.select(*kept).write.format("record_log").option("path", path).mode("append").save()


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log."""
    register(spark)
    return spark.read.format("record_log").option("path", path).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load()


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log as a stream, from the first on."""
    register(spark)
    return spark.readStream.format("record_log").option("path", path).load()
