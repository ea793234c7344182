"""Ordered folds in segments, on tables where one key has nine rows in ten, against plain folds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fixlattice.operators import deltas as D
from fixlattice.operators import graph as R
from fixlattice.operators import nodes as N
from fixlattice.operators.segments import cut


def _rows(n: int, seed: int):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng) for i in range(n)]


def test_a_hot_key_is_spread_over_tasks(spark):
    rows = [(i, k) for i, k, _ in _rows(4000, 1)]
    s = cut(spark.createDataFrame(rows, "seq long, name string"), ["name"], "seq", ranges=16)
    sizes = {(r["name"], r["_seg"]): r["count"] for r in s.rows.groupBy("name", "_seg").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) == 16 and max(hot) < 2 * sum(hot) / 16
    assert {seg for k, seg in sizes if k != "hot"} == {0}
    assert s.rows.count() == 4000


@pytest.mark.parametrize("ranges", [2, 16])
def test_carry_and_totals(spark, ranges):
    rows = [(i, k, rng.randrange(5)) for i, k, rng in _rows(1500, 2)]
    s = cut(spark.createDataFrame(rows, "seq long, name string, x long"), ["name"], "seq", ranges=ranges)
    out = s.with_carry(s.rows, {"n": F.sum("x")}, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    out = out.withColumn("sum", F.col("_carry") + F.sum("x").over(s.window()))
    out = s.with_totals(out, {"most": F.max("seq")})
    held, last = {}, {}
    for i, k, x in rows:
        held[i] = held.get(("k", k), 0) + x
        held["k", k] = held[i]
        last[k] = i
    assert all(r["sum"] == held[r.seq] and r.most == last[r.name] for r in out.collect())


def _no_whole_key_window(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            assert "_seg" in spec.split(" ASC")[0], line


def test_requests_of_one_name(spark):
    rng = random.Random(3)
    rows = []
    for i, name, _ in _rows(1200, 3):
        action = rng.choice(["cool", "advance", "rite", "other"])
        what = rng.choice(["execution", "testing", "nothing"]) if action == "cool" else rng.choice(["review", "none"])
        rows.append((i, name, action, what, rng.choice(["", "w", None])))
    found = N.validate(spark.createDataFrame(rows, "seq long, name string, action string, what string, witness string"))
    _no_whole_key_window(found, "name")
    tries, wanted = {}, {}
    for i, name, action, what, witness in rows:
        if action == "advance" and witness:
            tries[name] = tries.get(name, 0) + 1
        bad = (action == "cool" and what == "nothing", "unknown_step"), (action == "rite" and what == "none", "unknown_rite"), (action == "other", "unknown_action")
        bad += (action in ("cool", "advance") and not witness, "empty_witness"), (action == "advance" and tries.get(name, 0) > 9, "at_top")
        wanted[i] = next((r for test, r in bad if test), None)
    assert {r.seq: r.reason for r in found.collect()} == wanted


def test_coactivation_of_one_trace(spark):
    rng = random.Random(4)
    rows = [(i, k, rng.choice("abcxyz")) for i, k, _ in _rows(1500, 4)]
    calls = spark.createDataFrame(rows, "seq long, trace string, name string")
    found = R.coactivation(calls, F.col("name").isin("a", "b", "c"))
    _no_whole_key_window(found, "trace")
    last, wanted = {}, {}
    for _, t, name in rows:
        if name in "abc":
            if t in last and last[t] != name:
                wanted[last[t], name] = wanted.get((last[t], name), 0) + 1
            last[t] = name
    assert {(r.src, r.dst): r.w for r in found.collect()} == wanted


def _programs(seed, paths, n=900, share=0.9):
    rng = random.Random(seed)
    return [(0 if rng.random() < share else rng.randrange(1, 60), i, rng.choice(["override"] * 6 + ["add", "exclude"]), rng.choice(paths), str(rng.randrange(9))) for i in range(n)]


def test_compose_of_one_program(spark):
    rows = _programs(5, [f"p{i}" for i in range(200)])
    found = D.compose(spark.createDataFrame(rows, "program long, seq long, op string, path string, value string"))
    _no_whole_key_window(found, "program")
    firsts = {}
    for p, i, op, path, _ in rows:
        firsts.setdefault(p, {}).setdefault(path, []).append(op)
    bad = {p for p, by in firsts.items() for ops in by.values() if len(ops) > 1 and ("exclude" in ops or "add" in ops[1:])}
    assert {(r.program, r.path): (r.pos, r.status) for r in found.collect()} == {(p, x): (n, "refused" if p in bad else "ok") for p, by in firsts.items() for n, x in enumerate(by)}


def _leaves(tree, at=()):
    for k, v in tree.items():
        if isinstance(v, dict) and v:
            yield from _leaves(v, (*at, k))
        else:
            yield (*at, k), json.dumps(v)


@pytest.mark.parametrize("share, seed", [(0.0, 6), (0.9, 7), (0.02, 8)])
def test_nested_programs_against_the_fold(spark, share, seed):
    paths = [["a"], ["b"], ["a", "x"], ["a", "y"], ["a", "x", "1"], ["a", "x", "2"], ["b", "z"], ["b", "z", "1"], ["c", "x"], ["d"]]
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        p = 0 if rng.random() < share else rng.randrange(1, 300)
        op = rng.choice(["override", "override", "add", "exclude"]) if p else "override"
        # the hot program sets leaves alone, so that it runs to its end
        path = rng.choice(paths) if p else ["a", f"l{rng.randrange(40)}", "v"]
        rows.append((p, i, op if rng.random() < 0.99 or not p else "other", path if rng.random() < 0.99 or not p else [], str(rng.randrange(9))))
    base = {"a": {"x": {"1": 5}}, "b": 7, "e": {"f": 1}}
    leaves = [(list(p), v) for p, v in _leaves(base)]
    found = D.apply_nested(spark.createDataFrame(rows, "program long, seq long, op string, path array<string>, value string"), spark.createDataFrame(leaves, "path array<string>, value string"))
    if share > 0.5:
        _no_whole_key_window(found, "program")
    got = {}
    for r in found.collect():
        got.setdefault((r.program, r.abort_seq, r.reason), {})[tuple(r.path)] = r.value
    wanted = {}
    by = {}
    for p, i, op, path, value in rows:
        by.setdefault(p, []).append((i, op, path, value))
    for p, ops in by.items():
        tree, stop, reason = D.fold_tree(ops, json.loads(json.dumps(base)))
        wanted[p, stop, reason] = dict(_leaves(tree))
    assert len({s for _, s, _ in wanted}) > 1
    # the fold leaves containers that it made on the way to a violation; what came before the violation is what stands here
    for (p, stop, reason), tree in wanted.items():
        if stop is not None:
            tree = dict(_leaves(D.fold_tree([o for o in by[p] if o[0] < stop], json.loads(json.dumps(base)))[0]))
        assert got[p, stop, reason] == tree, (p, by[p])
    assert got.keys() == wanted.keys()


def test_touched_paths_alone(spark):
    rows = [(1, 1, "add", "x", "5"), (1, 2, "exclude", "y", None), (2, 3, "add", "y", "1")]
    d = spark.createDataFrame(rows, "program long, seq long, op string, path string, value string")
    base = spark.createDataFrame([("y", "0"), ("z", "9")], "path string, value string")
    assert sorted(map(tuple, D.apply_programs(d, base, whole=False).collect())) == [(1, "x", "5", "ok", None, None), (1, "y", None, "ok", None, None)]
    whole = sorted(map(tuple, D.apply_programs(d, base).collect()))
    assert whole == [(1, "x", "5", "ok", None, None), (1, "z", "9", "ok", None, None), (2, "y", "0", "refused", 3, "present"), (2, "z", "9", "refused", 3, "present")]


def test_programs_folded_by_the_batch_in_few_calls(spark, monkeypatch):
    monkeypatch.setattr(D, "_TREES", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]) if i % 3 else 5, i, rng.choice(["override", "add", "exclude", "other"]) if i % 3 else "override", [rng.choice("ab"), rng.choice("xyz")], str(i)) for i in range(3000)]
    base = {"a": {"x": 1}, "c": 2}
    d = spark.createDataFrame(rng.sample(rows, len(rows)), "program long, seq long, op string, path array<string>, value string")
    found = D.apply_trees(d, base)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r.program: (r.tree, r.status, r.abort_seq, r.reason) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for p, *op in rows:
        by.setdefault(p, []).append(op)
    wanted = {}
    for p, ops in by.items():
        tree, stop, reason = D.fold_tree(ops, json.loads(json.dumps(base)))
        wanted[p] = (json.dumps(tree, sort_keys=True), "ok" if stop is None else "refused", stop, reason)
    assert got == wanted and d.limit(0).count() == D.apply_trees(d.limit(0), base).count() == 0


def test_nested_programs_read_their_operations_once(spark):
    d = spark.createDataFrame([(1, 1, "add", ["a", "b"], "5"), (2, 2, "exclude", ["z"], None)], "program long, seq long, op string, path array<string>, value string")
    found = D.apply_nested(d, spark.createDataFrame([(["y"], "0")], "path array<string>, value string"))
    # what the segments read again is a written table, not the way there
    assert found.inputFiles() and all("/loop-" in f for f in found.inputFiles())
    assert {(r.program, tuple(r.path), r.value, r.status) for r in found.collect()} == {(1, ("a", "b"), "5", "ok"), (1, ("y",), "0", "ok"), (2, ("y",), "0", "refused")}
