"""The log as a data source: numbering, pruning, failed tasks, writers at once, streams."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from fixlattice.operators.log import latest
from fixlattice.sources import record_log


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)




def test_seq_is_gapless_over_appends_and_order_holds(spark, path):
    for k in range(3):
        df = spark.range(500).repartition(5).select(F.col("id").cast("string").alias("name"), F.lit(f"v{k}").alias("kind"), F.col("id").alias("at"))
        record_log.append(df, path, "at")
    got = record_log.records(spark, path).select("seq", "name", "kind").orderBy("seq").collect()
    assert [(r.seq, r.name, r.kind) for r in got] == [(500 * k + i, str(i), f"v{k}") for k in range(3) for i in range(500)]
    last = latest(record_log.records(spark, path).select("seq", "name", "kind")).collect()
    assert len(last) == 500 and all(r.kind == "v2" and r.seq == 1000 + int(r.name) for r in last)


def test_fields_survive_and_missing_ones_are_null(spark, path):
    rows = [("a", ["p", None], [["x"], []], None), (None, None, None, "w")]
    record_log.append(spark.createDataFrame(rows, "name string, provenance array<string>, golden_history array<array<string>>, witness_id string").coalesce(1).withColumn("seq", F.lit(99)).withColumn("other", F.lit(1)), path)
    got = record_log.records(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.name, r.provenance, r.golden_history, r.witness_id, r.kind) for r in got] == [(0, "a", ["p", None], [["x"], []], None, None), (1, None, None, None, "w", None)]


def test_a_log_that_is_not_there_is_empty_and_an_empty_append_counts(spark, path):
    assert record_log.records(spark, path).isEmpty()
    none = spark.createDataFrame([], "name string")
    record_log.append(none, path)
    record_log.append(spark.createDataFrame([("a",)], "name string"), path)
    assert [r.seq for r in record_log.records(spark, path).collect()] == [0]
    with pytest.raises(Exception, match="appended to"):
        record_log.register(spark)
        none.write.format("record_log").option("path", path).mode("overwrite").save()


def test_filters_skip_row_groups(spark, path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for k in range(4):
        record_log.append(spark.range(10).select(F.concat(F.lit(f"{k}-"), "id").alias("name")).coalesce(1), path)
    log = record_log.records(spark, path)
    some = log.where("seq >= 12 AND seq < 31 AND name IN ('1-3', '3-0', '0-1')")
    assert sorted(r.seq for r in some.collect()) == [13, 30]
    assert log.where("name = '2-5'").rdd.getNumPartitions() == 1
    assert log.where("seq > 35").rdd.getNumPartitions() == 1
    assert log.where("seq > 99").isEmpty()
    reader = record_log.LogReader(path, log.schema)
    assert len(reader.partitions()) == 4


def test_a_failed_append_leaves_nothing(spark, path):
    record_log.append(spark.createDataFrame([("a",)], "name string"), path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).cast("string").alias("name"))
    with pytest.raises(Exception):
        record_log.append(bad, path)
    record_log.append(spark.createDataFrame([("b",)], "name string"), path)
    assert sorted((r.seq, r.name) for r in record_log.records(spark, path).collect()) == [(0, "a"), (1, "b")]


def test_writers_at_once_get_numbers_of_their_own(path):
    schema = record_log.LOG_TYPE

    def write(k):
        record_log.LogWriter(path, schema).commit([record_log.Written(0, f"f{k}", 7, [(7, "a", "z", False)])])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    commits = record_log._Folder(path).commits()
    assert [c["number"] for c in commits] == list(range(12)) and [c["files"][0]["first"] for c in commits] == [7 * k for k in range(12)]


def test_stream_of_a_log_and_into_a_log(spark, path, tmp_path):
    for k in range(3):
        record_log.append(spark.createDataFrame([(f"n{k}",), ("all",)], "name string").coalesce(1), path)
    to = str(tmp_path / "copy")

    def run():
        query = record_log.stream(spark, path).writeStream.format("record_log").option("path", to).option("writer", "copy").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    record_log.append(spark.createDataFrame([("late",)], "name string"), path)
    run()
    run()
    assert sorted((r.seq, r.name) for r in record_log.records(spark, to).collect()) == [(0, "n0"), (1, "all"), (2, "n1"), (3, "all"), (4, "n2"), (5, "all"), (6, "late")]
    # a batch that is committed again changes nothing
    schema = record_log.LOG_TYPE
    before = record_log._Folder(to).count()
    record_log.LogStreamWriter(to, schema, "copy").commit([record_log.Written(0, "again", 1, [(1, "a", "a", False)])], 0)
    assert record_log._Folder(to).count() == before
