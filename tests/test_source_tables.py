"""Tables of sources: dealt over tasks, and the rows of the table functions a batch at a time."""

import pytest
from pyspark.sql import functions as F

from fixlattice.operators import source_rows as B
from fixlattice.plans import checking
from fixlattice.session import dealt


def test_sources_of_one_file_are_dealt_over_tasks(spark, sf):
    # the parts are one file of one partition
    sources = checking._sources(spark, sf)
    assert sources.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sources.count() == 4 * spark.read.parquet(f"{sf}/part.parquet").count()


def test_partitions_follow_the_rows(spark):
    df = spark.range(1000).coalesce(1)
    assert dealt(df, "id", 10).rdd.getNumPartitions() == 100 and dealt(df.limit(0), "id").count() == 0


def _functions():
    return [(B.ModuleReport, ()), (B.StaticCalls, ()), (B.Signature, ()), (B.Blockify, (True,)), (B.Blockify, (True, False)), (B.CallableUnit, ()), (B.SelfAccesses, ()), (B.Derive, ())]


@pytest.mark.parametrize("function, args", _functions())
def test_batches_give_the_rows_of_lateral_joins(spark, sf, function, args):
    odd = [("x", "def f(:"), ("y", None), ("z", "x = 1"), ("e", ""), ("d", '    def f(a, *b, c=len, **d):\n        "text"\n        def g(): return a\n        a = open(c)\n'), ("m", "class A:\n    def m(self): return self.x, self._y\ndef f(): return g()\ndef g(): return super()\n")]
    sources = checking._sources(spark, sf).limit(200).unionByName(spark.createDataFrame([*odd, *odd], "source_name string, src string"))
    wanted = sources.lateralJoin(function(F.col("src").outer(), *map(F.lit, args)).alias("r")).select("source_name", "r.*")
    found = B.applied(sources, function, *args)
    assert found.schema == wanted.schema
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    assert B.applied(sources.limit(0), function, *args).count() == 0
