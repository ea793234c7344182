"""Fronts, draws and interval counts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixlattice.functions import lattice as L
from fixlattice.operators import selection as S


def plain_front(rows):
    return {r for r in rows if not any(all(a >= b for a, b in zip(o[1:], r[1:])) and o[1:] != r[1:] for o in rows)}


def _tables():
    rng = random.Random(1)
    yield "two keys", [(i, rng.randrange(60), rng.randrange(60)) for i in range(700)]
    yield "anticorrelated", [(i, i // 2, 400 - i // 2 + rng.randrange(2)) for i in range(800)]
    yield "three keys", [(i, rng.randrange(12), rng.randrange(12), rng.random()) for i in range(600)]
    yield "all equal", [(i, 5, 5) for i in range(50)]
    yield "one key", [(i, rng.randrange(9)) for i in range(100)]
    yield "one row", [(0, 1, 2, 3, 4)]


@pytest.mark.parametrize("name, rows", list(_tables()), ids=[n for n, _ in _tables()])
def test_front(spark, name, rows):
    keys = [f"k{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, ["pos", *keys]).repartition(5)
    assert {tuple(r) for r in S.pareto_front(df, keys).select("pos", *keys).collect()} == plain_front(rows)


def test_front_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(0, None, 5), (1, 1, 1), (2, 0, 0)], "pos long, a long, b long")
    assert [r.pos for r in S.pareto_front(df, ["a", "b"]).collect()] == [1]
    assert S.pareto_front(df.limit(0), ["a", "b"]).isEmpty()
    assert S.pareto_front(df.where("pos = 0"), ["a", "b"]).isEmpty()


def test_a_front_of_large_numbers_is_exact(spark):
    big = 1 << 60
    rows = [(0, big, big + 1), (1, big + 1, big), (2, big, big), (3, big - 1, big + 1)]
    assert {r.pos for r in S.pareto_front(spark.createDataFrame(rows, "pos long, a long, b long"), ["a", "b"]).collect()} == {0, 1}


def test_a_front_is_dealt_out_by_cells(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("a"), (n - F.col("id")).alias("b"))
    front = S.pareto_front(df, ["a", "b"])
    assert front.count() == n
    plan = front._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Coalesce " not in plan


def test_positions_of_a_front_in_many_keys():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 4):
        rows = rng.integers(0, 6, (300, d))
        wanted = [i for i, r in enumerate(rows) if not any((o >= r).all() and (o > r).any() for o in rows)]
        assert sorted(S.front_positions([rows[:, k] for k in range(d)])) == wanted


def plain_tournament(rows, mu, size, seed):
    import hashlib

    left, won = dict(rows), []
    for n in range(1, mu + 1):
        drawn = sorted(left, key=lambda p: (hashlib.md5(f"{seed}:{n}:{p}".encode()).hexdigest(), p))[:size]
        if not drawn:
            break
        best = max(drawn, key=lambda p: left[p])
        won.append((best, n))
        del left[best]
    return won


@pytest.mark.parametrize("n, mu, size", [(200, 12, 3), (5, 9, 2), (30, 1, 50), (0, 3, 2), (10, 0, 2)])
def test_tournament(spark, n, mu, size):
    rng = random.Random(n)
    rows = [(i, rng.randrange(5) / 4) for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, primary double").repartition(4)
    assert sorted((r["pos"], r["rank"]) for r in S.tournament(df, mu, size, 7).collect()) == sorted(plain_tournament(rows, mu, size, 7))


def test_intervals_that_are_apart(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lo = rng.randrange(50) / 10
        rows.append((i, lo, lo + rng.randrange(20) / 10))
    df = spark.createDataFrame(rows, "name long, lo double, hi double").repartition(4)
    wanted = {(a, b) for a, lo, _ in rows for b, _, hi in rows if lo > hi}
    pairs = S.significantly_above(df, "name")
    assert {(r.above, r.below) for r in pairs.collect()} == wanted and pairs.count() == len(wanted)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    counts = {r.name: r.n_below for r in S.counts_below(df, "name").collect()}
    assert counts == {a: sum(x == a for x, _ in wanted) for a, _, _ in rows}


def test_sums_over_all_states_above(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10), rng.randrange(128), rng.randrange(64), rng.randrange(1, 5)) for _ in range(300)]
    above = L.count_above(spark.createDataFrame(rows, "level int, w long, r long, n long"))
    got = dict(above.join(F.broadcast(spark.createDataFrame([(l * 8192 + w * 64 + r,) for l, w, r, _ in rows], "index int")), "index").collect())
    for l, w, r, _ in rows:
        assert got[l * 8192 + w * 64 + r] == sum(n for m, x, y, n in rows if m >= l and x & w == w and y & r == r)
    assert above.count() == 81_920
