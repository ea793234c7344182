"""Registries, rules, assembly and digests on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fixlattice.functions import lattice as L
from fixlattice.operators import checks as X
from fixlattice.operators import registry as G
from fixlattice.operators import rules as U
from fixlattice.operators.nodes import equivalent
from fixlattice.plans import records
from fixlattice.sources import log_store, record_log, ring_files


def test_registry_of_an_empty_log_and_last_verdict(spark, tmp_path):
    path = str(tmp_path / "log")
    assert G.registry(record_log.records(spark, path)).isEmpty() and G.promotions(record_log.records(spark, path)).isEmpty()
    g = spark.createDataFrame([("a", "[1]", "KEEP", 0.5), ("b", None, "REJECT", None)], "id string, ops string, verdict string, fitness double")
    record_log.append(G.genome_records(g), path)
    record_log.append(G.genome_records(g.where("id = 'a'").withColumn("verdict", F.lit("REJECT"))), path)
    record_log.append(G.champion_records(g), path)
    record_log.append(spark.createDataFrame([("a", "witness", "process_rerun:x"), ("b", "witness", "seat")], "name string, kind string, witness_id string"), path)
    log = record_log.records(spark, path)
    assert {(r.id, r.verdict, r.ops, r.fitness) for r in G.registry(log).collect()} == {("a", "REJECT", "[1]", 0.5), ("b", "REJECT", None, None)}
    assert {(r.id, r.gauged, r.promoted, r.pending) for r in G.promotions(log).collect()} == {("a", True, False, "external_acceptance"), ("b", True, True, None)}


def test_rules_say_what_the_lattice_computes(spark):
    states = spark.createDataFrame([(i, i % 10, (i * 37) % 128, (i * 11) % 64) for i in range(300)] + [(1000, 9, 127, 63), (1001, 9, 127, 0), (1002, 0, 127, 63)], "id long, level int, w long, r long")
    level, w, r = L.closure_step(F.col("level"), F.col("w"), F.col("r"))
    wanted = {tuple(x) for x in states.select("id", level, w, r).collect()}
    assert {(x.id, x.level, x.w, x.r) for x in U.apply_rule(spark, "closure_step", states).collect()} == wanted
    chain = {(x.id, x.step, x.level, x.w, x.r) for x in U.apply_rule(spark, "kleene", states).collect()}
    assert chain == {(x.id, x.step, x.level, x.w, x.r) for x in L.chain(states).collect()}
    assert U.apply_rule(spark, "next_level").count() == 9


def test_assembly_refuses_in_order(spark):
    verb = "array<struct<name:string,slots:array<string>,accesses:array<string>>>"
    rows = [
        ("ok", 0, ["a"], [], [("a", ["s"], ["a", "s"])]),
        ("ok", 1, ["b"], ["a"], [("b", [], ["a", "b"])]),
        ("gap", 0, ["a"], ["b"], [("x", [], ["y"])]),
        ("outside", 0, ["a"], [], [("a", [], []), ("x", [], ["y"])]),
        ("leak", 0, ["a"], [], [("a", ["s"], ["z", "y", "z"]), ("x", [], [])]),
        ("deep", 0, ["a"], [], []),
        ("deep", 1, ["b"], ["c"], [("b", [], [])]),
    ]
    df = spark.createDataFrame(rows, f"key string, depth int, adds array<string>, requires array<string>, verbs {verb}")
    got = {r.key: (r.status, r.depth, r.reason, r.verb, r.names) for r in X.assemble(df, "key").collect()}
    assert got == {"ok": ("ok", None, None, None, None), "gap": ("refused", 0, "missing", None, ["b"]), "outside": ("refused", 0, "outside_adds", "x", ["x"]), "leak": ("refused", 0, "leak", "a", ["y", "z"]), "deep": ("refused", 1, "missing", None, ["c"])}


def test_digests_tell_multisets_apart(spark):
    a = spark.createDataFrame([(1, "x", [1.0]), (1, "x", [1.0]), (2, None, None)], "a int, `b c` string, d array<double>")
    assert log_store.digest(a) == log_store.digest(a.repartition(3))
    assert log_store.digest(a) != log_store.digest(a.distinct()) and log_store.digest(a.limit(0)) == (0, 0, 0)
    assert equivalent(a, a.orderBy(F.desc("a"))) and not equivalent(a, a.withColumn("b c", F.lit("x")))
    assert sorted((r.a, r.side) for r in log_store.differences(a, a.distinct()).collect()) == [(1, "left")]


@pytest.mark.parametrize("substrate", sorted(log_store.SUBSTRATES))
def test_substrates_preserve_rows(spark, tmp_path, substrate):
    df = spark.createDataFrame([(1, "x\ny"), (None, None)], "a long, b string")
    assert log_store.preserved(df, substrate, str(tmp_path / "t"))


def test_a_digest_beyond_a_long(spark):
    text = next(str(i) for i in range(10_000) if hashlib.md5(str(i).encode()).hexdigest().startswith("ff"))
    one = int(hashlib.md5(text.encode()).hexdigest()[:10], 16)
    few = spark.range(1000).select(F.lit(text).alias("x"))
    assert log_store.digests(few, ["x"]) == (log_store.digest(few), 1000 * one) and log_store.digests(few.limit(0), ["x"]) == ((0, 0, 0), 0)
    n = 10_000_000
    assert n * one >= 1 << 63
    assert log_store.digests(spark.range(n).select(F.lit(text).alias("x")), ["x"])[1] == n * one - (1 << 64)


def test_round_trips_hold_one_slice_on_disk(spark, tmp_path, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("a"), F.concat(F.lit("x\ny"), F.col("id") % 3).alias("b c"))
    df = df.union(df.where("a < 100")).repartition(2)
    wanted, rows, seen, read_back = log_store.digests(df, ["a"]), df.count(), [], log_store.read_back

    def watched(part, substrate, path):
        back = read_back(part, substrate, path)
        seen.append((back.count(), len(list(tmp_path.iterdir()))))
        return back

    monkeypatch.setattr(log_store, "read_back", watched)
    monkeypatch.setattr(log_store, "SLICE_ROWS", 300)
    for s in sorted(log_store.SUBSTRATES):
        assert log_store.digests_back(df, s, f"file://{tmp_path}/{s}", ["a"], rows) == wanted
        assert sum(n for n, _ in seen) == rows and len(seen) == 4 and all(150 < n < 450 and held == 1 for n, held in seen)
        seen.clear()
        assert log_store.preserved(df, s, f"file://{tmp_path}/{s}") and log_store.preserved(df.limit(0), s, f"file://{tmp_path}/{s}")
        seen.clear()
    monkeypatch.setattr(log_store, "read_back", lambda part, substrate, path: read_back(part, substrate, path).select(F.raise_error(F.lit("lost")).alias("a"), "b c"))
    with pytest.raises(Exception, match="lost"):
        log_store.preserved(df, "json", f"file://{tmp_path}/x")
    assert not list(tmp_path.iterdir())


def test_substrate_digests_leave_nothing(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "shared_root", lambda spark: f"file://{tmp_path}")
    whole = {tuple(r) for r in records.substrate_digests(spark, sf).collect()}
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(log_store, "SLICE_ROWS", 2000)
    assert {tuple(r) for r in records.substrate_digests(spark, sf).collect()} == whole
    assert not list(tmp_path.iterdir())


def test_rings_of_one_file_of_parts_are_many_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "_fresh", lambda spark, name: f"file://{tmp_path}/{name}")
    for query, folder in ((records.ring_owl_files, "owl"), (records.ring_xml_files, "rings")):
        assert query(spark, sf).collect()
        assert len([f for f in (tmp_path / folder).iterdir() if f.name.startswith("part-")]) > 1


def test_written_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ring_files, "FILE_RINGS", 10)
    rows = [(f"r{i}", ["a"], ["b"], [("v", "s", ["x"])]) for i in range(35)]
    rings = spark.createDataFrame(rows, "name string, adds array<string>, requires array<string>, verbs array<struct<name:string,source:string,slots:array<string>>>").coalesce(1)
    ring_files.write_rings(rings, f"file://{tmp_path}/x")
    assert len([f for f in (tmp_path / "x").iterdir() if f.name.startswith("part-")]) == 4
    assert ring_files.read_rings(spark, f"file://{tmp_path}/x").where("status = 'ok'").count() == 35
