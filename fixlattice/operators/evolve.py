"""Evolution of delta programs: a bounded driver loop with one scoring job a generation and a registry of what was scored.

The driver holds genomes (a brood is at most ``lam``, a run at most ``budget``); scoring is a function from a DataFrame of
genomes to one of fitness, so a whole brood is one job.
"""

from __future__ import annotations

import copy
import hashlib
import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlattice.operators.deltas import fold_tree

Op = tuple[str, tuple[str, ...], object]
GENOME = "id string, ops string, generation int, fitness double, verdict_at_eval string"


def genome_id(ops: list[Op]) -> str:
    """Content address: SHA-256 of the operations' JSON, in order."""
    return "g_" + hashlib.sha256(json.dumps([[op, list(path), value] for op, path, value in ops], sort_keys=True).encode()).hexdigest()[:16]


def cross(a: list[Op], b: list[Op]) -> tuple[list[Op] | None, list[tuple]]:
    """(child, conflicts): paths of a, then those of b alone; any conflict and there is no child."""
    left, right = {p: (op, v) for op, p, v in a}, {p: (op, v) for op, p, v in b}
    clash = [p for p in left if p in right and json.dumps(left[p]) != json.dumps(right[p])]
    return (None, clash) if clash else ([(op, p, v) for p, (op, v) in (left | right).items()], [])


def phenotype(base: dict, ops: list[Op]) -> dict:
    """The nested tree that the operations make of base; the first violation raises its reason."""
    tree, _, reason = fold_tree(((i, op, path, json.dumps(value)) for i, (op, path, value) in enumerate(ops)), copy.deepcopy(base))
    if reason:
        raise ValueError(reason)
    return tree


Scored = tuple[list[Op], float]


def best_with_baseline(pool: list[Scored], mu: int, baseline: float, rng: random.Random) -> list[Scored]:
    """The best mu; the baseline competes as the last candidate and may cost a place."""
    ranked = sorted([*pool, (None, baseline)], key=lambda s: -s[1])[:mu]
    return [s for s in ranked if s[0] is not None]


def best_above(pool: list[Scored], mu: int, baseline: float, rng: random.Random) -> list[Scored]:
    """The best mu strictly above the baseline."""
    return sorted((s for s in pool if s[1] > baseline), key=lambda s: -s[1])[:mu]


def tournaments(pool: list[Scored], mu: int, baseline: float, rng: random.Random, size: int = 2) -> list[Scored]:
    """mu winners of draws of ``size`` without replacement."""
    left, won = list(pool), []
    while left and len(won) < mu:
        best = max(rng.sample(range(len(left)), min(size, len(left))), key=lambda i: left[i][1])
        won.append(left.pop(best))
    return won


def evolve(
    spark: SparkSession, base: dict, score: Callable[[DataFrame], DataFrame], mutate: list[Callable[[list[Op], random.Random], list[list[Op]]]], generations: int = 3, mu: int = 2, lam: int = 4, budget: int = 64,
    crossover_rate: float = 0.0, seed: int = 0, select: Callable[[list[Scored], int, float, random.Random], list[Scored]] = best_with_baseline, registry: DataFrame | None = None,
) -> DataFrame:
    """All genomes that this run scored (GENOME), the baseline first, with generation -1 and verdict BASELINE.

    score: (id, config JSON) -> (id, fitness) or (id, k, n), a rate. The unchanged base is scored first and its fitness is what
    ``select`` (pool, mu, baseline, rng) gets; mutators start from the survivors, or from the empty program. A genome is scored
    once, ever: those of ``registry`` (id, ...), an earlier run's rows or a log's, are passed over; the driver asks for a brood's ids alone.
    """
    rng, verdicts, rows, spent = random.Random(seed), {}, [], 0

    def fitness(genomes: dict[str, list[Op]]) -> tuple[dict[str, float], set[str]]:
        viable, dead = [], set()
        for i, ops in genomes.items():
            try:
                viable.append((i, json.dumps(phenotype(base, ops), sort_keys=True)))
            except ValueError:
                dead.add(i)
        got = score(spark.createDataFrame(viable, "id string, config string")) if viable else None
        if got is not None and "fitness" not in got.columns:
            got = got.select("id", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("fitness"))
        return {r["id"]: r["fitness"] for r in got.collect()} if viable else {}, dead

    def known(ids: list[str]) -> set[str]:
        earlier = {r["id"] for r in registry.where(F.col("id").isin(ids)).select("id").distinct().collect()} if registry is not None and ids else set()
        return earlier | verdicts.keys()

    def row(i: str, ops: list[Op], generation: int, value: float | None, verdict: str) -> tuple:
        return i, json.dumps([[op, list(p), v] for op, p, v in ops]), generation, value, verdict

    first = genome_id([])
    found, _ = fitness({first: []})
    baseline = found.get(first)
    baseline = float("-inf") if baseline is None else baseline
    verdicts[first] = "BASELINE"
    rows.append(row(first, [], -1, found.get(first), "BASELINE"))
    survivors: list[Scored] = []
    for generation in range(generations):
        brood = [child for ops in ([o for o, _ in survivors] or [[]]) for m in mutate for child in m(ops, rng)]
        if len(survivors) > 1 and rng.random() < crossover_rate:
            child, _ = cross(*(s[0] for s in rng.sample(survivors, 2)))
            brood += [child] if child else []
        by_id = {i: o for o in reversed(brood) for i in [genome_id(o)]}
        old = known(list(by_id))
        fresh = dict([(i, o) for i, o in reversed(by_id.items()) if i not in old][: min(lam, budget - spent)])
        got, dead = fitness(fresh)
        spent += len(fresh) - len(dead)
        scored = [(fresh[i], f) for i, f in ((i, got.get(i)) for i in fresh) if f is not None]
        survivors = select(scored + survivors, mu, baseline, rng)
        kept = {genome_id(o) for o, _ in survivors}
        for i, ops in fresh.items():
            verdicts[i] = "UNVIABLE" if i in dead else "KEEP" if i in kept else "REJECT"
            rows.append(row(i, ops, generation, got.get(i), verdicts[i]))
        if spent >= budget:
            break
    return spark.createDataFrame(rows, GENOME)
