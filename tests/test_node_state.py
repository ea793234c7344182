"""Evidence of names in keyed state: merging, batches, timers."""

import datetime
import random

import pyarrow as pa
from pyspark.sql import functions as F

from fixlattice.operators import log as G
from fixlattice.sources.log_store import LOG_SCHEMA
from fixlattice.streaming import node_state as S


def _log(n, seed, names="aab"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["node", "node", "witness"])
        tests = [["t"], [], None][rng.randrange(3)]
        out.append((i, rng.choice(names), kind, None, rng.choice(["x", "y", "z", "", None]), rng.choice(["program", "function", None]), None, None, ["d"] if i % 3 else [], None, [], tests, [["testing"], ["execution", "no such step"]] if i % 5 == 0 else None, rng.choice(["seat", "process_rerun:1", None]) if kind == "witness" else None))
    return out


COLUMNS = ["n_nodes", "level_name", "has_docs", "has_tests", "has_packages", "has_identity", "tested", "cooled", "n_external"]


def _expected(spark, rows):
    found = G.evidence(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    return {r["name"]: [r[c] for c in COLUMNS] + [min(2, r["n_identities"])] for r in found}


def test_states_merge_in_any_order(spark):
    rows = _log(120, 1)
    each = [r.asDict() for r in S._each(spark.createDataFrame(rows, LOG_SCHEMA), None).collect()]
    random.Random(2).shuffle(each)
    held = {}
    for r in each:
        name = r.pop("name")
        held[name] = S.merged(held[name], r) if name in held else r
    assert {n: [h[c] for c in COLUMNS] + [len(h["identities"])] for n, h in held.items()} == _expected(spark, rows)


def test_stream_equals_one_look_at_the_log_and_timers_tell_idle_names(spark, tmp_path):
    rows = _log(90, 3, ["hot"] * 9 + ["a", None])
    times = ["2024-01-01 00:00:00"] * 60 + ["2024-01-04 00:00:00"] * 30
    rows = [r if i < 60 else (r[0], "hot", *r[2:]) for i, r in enumerate(rows)]
    schema = LOG_SCHEMA + ", time string"
    for k in range(3):
        part = [(*r, t) for r, t in list(zip(rows, times))[30 * k : 30 * k + 30]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    spark.createDataFrame([(1000, "hot", "witness", *[None] * 11, "2024-01-04 01:00:00")], schema).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    states = S.evidence_stream(stream, "time", idle="1 day", late="1 hour")
    out = str(tmp_path / "out")
    write = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/{i}")
    query = states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    got = {}
    idle = set()
    for r in sorted(spark.read.parquet(f"{out}/*").collect(), key=lambda r: (r.n_records, r.batch)):
        got[r["name"]] = [r[c] for c in COLUMNS] + [r.n_identities]
        if r.idle:
            idle.add(r["name"])
    wanted = _expected(spark, [*rows, (1000, "hot", "witness", *[None] * 11)])
    assert got == wanted and {"a", None} <= idle and wanted.keys() == {"hot", "a", None}


def test_a_task_gives_each_name_once_whatever_its_batches():
    rng = random.Random(5)
    schema = pa.schema([("name", pa.string()), ("time", pa.timestamp("us", "UTC")), *[(c, pa.int64()) for c in ("n_records", "n_nodes", "last_seq")], ("level_name", pa.string()), *[(c, pa.bool_()) for c in ("has_docs", "has_tests", "has_packages", "has_identity")], ("identities", pa.list_(pa.string())), ("tested", pa.bool_()), ("cooled", pa.int64()), ("n_external", pa.int64())])
    rows = []
    for i in range(400):
        node = rng.random() < 0.6
        flags = {c: rng.random() < 0.5 if node else None for c in ("has_docs", "has_tests", "has_packages", "has_identity")}
        time = rng.choice([None, datetime.datetime(2024, 1, 1 + rng.randrange(20), tzinfo=datetime.timezone.utc)])
        identities = [rng.choice(["z", "é", "￿", "\U0001f600"])] if node and rng.random() < 0.5 else []
        rows.append(dict(name=rng.choice(["a", "b", "", None, *"cdefgh"]), time=time, n_records=1, n_nodes=int(node), last_seq=i if node else None, level_name=rng.choice(["program", None]) if node else None, **flags, identities=identities, tested=rng.random() < 0.1, cooled=rng.randrange(128) if i % 7 == 0 else 0, n_external=int(not node)))
    rng.shuffle(rows)
    wanted = {}
    for r in rows:
        before = wanted.get(r["name"])
        times = [x["time"] for x in (before or r, r) if x["time"] is not None]
        wanted[r["name"]] = r if before is None else S.merged(before, r) | {"name": r["name"], "time": max(times, default=None)}
    batches = pa.Table.from_pylist(rows, schema=schema).to_batches(3)
    got = [r for b in S._merge_batches(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(wanted) and {r["name"]: r for r in got} == wanted
    assert list(S._merge_batches(iter([]))) == []


def test_a_stream_without_times_is_aggregated_by_the_engine_and_equals_one_look(spark, tmp_path):
    rows = [r if r[1] != "w" else (*r[:2], "witness", *r[3:]) for r in _log(120, 4, ["hot"] * 9 + ["a", "w", None])]
    parts = [rows[i::3] for i in (2, 0, 1)]  # each batch has records from the whole log, so later ones come with lesser numbers too
    out = str(tmp_path / "out")
    (tmp_path / "log").mkdir()
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "log"))
    states = S.evidence_stream(stream)
    plan = states._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "MapInArrow" not in plan
    write = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/{i}")
    for part in parts:
        spark.createDataFrame(part, LOG_SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "log"))
        query = states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    found = spark.read.parquet(f"{out}/*")
    got = {r["name"]: [r[c] for c in COLUMNS] + [r.n_identities] for r in sorted(found.collect(), key=lambda r: r.n_records)}
    assert got == _expected(spark, rows) and got.keys() == {"hot", "a", "w", None}
    assert found.where("idle").isEmpty() and found.where("name = 'hot'").count() == 3
