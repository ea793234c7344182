"""Node requests (cool, advance, receive a rite) validated in batches, node state from accepted ones, and loop chains as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixlattice.functions import lattice as L
from fixlattice.functions.dims import CONDITIONAL_VERBS, COOLING, LADDER, LOOP, RITES, mask_of, nth
from fixlattice.operators.segments import cut
from fixlattice.sources.log_store import digest


def level_index(name: Column) -> Column:
    """Place on the ladder, null for an unknown name."""
    at = F.array_position(F.array(*[F.lit(x) for x in LADDER]), name)
    return F.when(at > 0, (at - 1).cast("int"))


def next_level(name: Column) -> Column:
    return nth(LADDER, level_index(name) + 1)


def admissible(a: Column, b: Column) -> Column:
    """Whether b is the rung right above a."""
    return F.coalesce(next_level(a) == b, F.lit(False))


def validate(requests: DataFrame) -> DataFrame:
    """requests (seq, name, action, what, witness) with status and reason.

    cool needs a known step and a witness; advance needs a witness and a rung above (its place is counted from the advances accepted
    before it, beginning at the first rung); a rite needs a known name and takes an empty witness too. Advances are counted in segments
    of a name, by a counter that stops above the last rung.
    """
    empty = F.coalesce("witness", F.lit("")) == ""
    above = L.TOP_LEVEL + 1
    climbs = F.when((F.col("action") == "advance") & ~empty, 1).otherwise(0)
    segments = cut(requests, ["name"], "seq")
    rows = segments.with_carry(segments.rows, {"n": F.sum(climbs)}, F.lit(0).cast("long"), lambda held, s: F.least(held + s["n"], F.lit(above)))
    tries = F.col("_carry") + F.sum(climbs).over(segments.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reason = (
        F.when((F.col("action") == "cool") & ~F.col("what").isin(*COOLING), "unknown_step")
        .when((F.col("action") == "rite") & ~F.col("what").isin(*RITES), "unknown_rite")
        .when(~F.col("action").isin("cool", "advance", "rite"), "unknown_action")
        .when(F.col("action").isin("cool", "advance") & empty, "empty_witness")
        .when((F.col("action") == "advance") & (F.col("_tries") > L.TOP_LEVEL), "at_top")
    )
    marked = rows.withColumn("_tries", tries)
    return marked.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("refused")).drop("_tries", "_carry", "_seg")


def state(validated: DataFrame) -> DataFrame:
    """(name, level, w, r, heat, golden, is_agent, provenance_size) of every name from its accepted requests."""
    ok = F.col("status") == "ok"
    g = validated.groupBy("name").agg(
        F.sum(F.when(ok & (F.col("action") == "advance"), 1).otherwise(0)).cast("int").alias("level"),
        F.coalesce(F.bit_or(F.when(ok & (F.col("action") == "cool"), mask_of(F.array("what"), COOLING))), F.lit(0)).alias("w"),
        F.coalesce(F.bit_or(F.when(ok & (F.col("action") == "rite"), mask_of(F.array("what"), RITES))), F.lit(0)).alias("r"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("provenance_size"),
    )
    return g.withColumns({"heat": 1 - F.bit_count("w") / 7.0, "golden": F.col("w") == L.ALL_COOLING, "is_agent": F.col("r") == L.ALL_RITES})


def project_state(log: DataFrame, prefix: str, files: dict[str, bool]) -> DataFrame:
    """(level, w, r) of a whole project: what files exist, and what its own records (names with the prefix) and external witnesses show."""
    from fixlattice.operators.log import is_external

    own = F.coalesce(F.startswith(F.col("name"), F.lit(prefix)), F.lit(False))
    node, wit = own & (F.col("kind") != "witness"), own & (F.col("kind") == "witness") & is_external(F.col("witness_id"))
    provenance = F.coalesce("provenance", F.array().cast("array<string>"))
    found = log.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("seen", node), ("kept", node & (F.size(provenance) > 0)), ("external", wit), ("improved", node & F.exists(provenance, lambda p: p.contains("improve_compiler"))))])
    claims_w = {"execution": F.lit(files.get("suite", False)), "testing": F.lit(files.get("suite", False)), "relational_validation": F.lit(files.get("facts", False)), "observation": F.col("seen"), "independent_witnessing": F.col("external"), "provenance": F.col("kept"), "append_only_crystallization": F.col("seen")}
    claims_r = {"explanation": F.lit(files.get("manual", False)), "evolution": F.col("improved"), "testing": F.lit(files.get("tests", False)), "export": F.lit(files.get("package", False)), "review": F.col("external"), "graph_identity": F.col("seen")}
    mask = lambda names, claims: sum((F.when(claims[n], 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0)).cast("bigint")
    return found.select(F.when(F.col("seen"), LADDER.index("graph_entity")).otherwise(LADDER.index("program")).alias("level"), mask(COOLING, claims_w).alias("w"), mask(RITES, claims_r).alias("r"))


def drive(states: DataFrame) -> DataFrame:
    """states (key columns, level, w, r) driven to the top: level, w, r there and cycles, one more than the steps because the last changes nothing."""
    d = L.distance(F.col("level"), F.col("w"), F.col("r"))
    return states.select(*[c for c in states.columns if c not in ("level", "w", "r")], (d + 1).alias("cycles"), F.lit(L.TOP_LEVEL).alias("level"), F.lit(L.ALL_COOLING).cast("bigint").alias("w"), F.lit(L.ALL_RITES).cast("bigint").alias("r"))


Step = Callable[[dict, DataFrame], tuple[dict, DataFrame]]


def run_chain(steps: dict[str, Step], context: dict, df: DataFrame) -> tuple[dict, DataFrame, DataFrame]:
    """(context, table, trace): the verbs in order, each a function of context and table; the conditional ones wait for context['witnessed_effect'].

    A verb without a step counts as fired and passes its input through. trace: (idx, verb, fired).
    """
    trace = []
    for i, verb in enumerate(LOOP):
        fired = verb not in CONDITIONAL_VERBS or bool(context.get("witnessed_effect"))
        if fired and verb in steps:
            context, df = steps[verb](dict(context), df)
        trace.append((i, verb, fired))
    return context, df, df.sparkSession.createDataFrame(trace, "idx int, verb string, fired boolean")


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables are the same query."""
    return a.sameSemantics(b)


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as multisets, by their digests: columns by place."""
    return digest(a) == digest(b.toDF(*a.columns))
