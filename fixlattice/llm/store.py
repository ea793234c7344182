"""Written intermediate tables in the folder that all executors share.

A table that is written here and read again cuts the lineage: a lost executor
costs the tasks of one later stage, never the passes before the table.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a folder of our own on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = "file://" + tempfile.mkdtemp(prefix="fixlattice-")
    return _own["root"]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle partitions that go into one file of a narrow table: partitions are sized for texts, its rows hold ids.
NARROW = 8


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a written table: computed once, read from the shared folder by all that follows. narrow: rows of a few numbers that come from a shuffle, in fewer files."""
    path = fresh(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    if (held := _scratch.get()) is not None:
        held.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing will read any more."""
    if path := getattr(df, "_written_path", None):
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch() -> Iterator[list]:
    """Tables of ``written`` that are made inside are deleted at the end; those of ``result`` go to the scratch around it, if any."""
    held: list[DataFrame] = []
    token = _scratch.set(held)
    outer = None if token.old_value is token.MISSING else token.old_value
    try:
        yield held
    finally:
        _scratch.reset(token)
        for df in held:
            if not getattr(df, "_outlives", False):
                discard(df)
            elif outer is not None:
                df._outlives = False
                outer.append(df)


def result(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a written table that outlives the scratch it is made in."""
    out = written(df, name, narrow)
    out._outlives = True
    return out


def _target(path: str):
    """(pyarrow file system, path in it); shared folders are reached by the scheme of their URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def write_file(path: str, *chunks: bytes) -> None:
    """Writes under another name and renames: a task that is run again, or twice at once, leaves the same whole file."""
    system, at = _target(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(temporary, at)


def mapped_file(path: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where it is in a mounted folder, else read."""
    system, at = _target(path)
    if system.type_name == "local":
        return np.memmap(at, np.uint8, "r") if os.path.getsize(at) else np.empty(0, np.uint8)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint8)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields; the given one stays as it is."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names like the stems that df doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
