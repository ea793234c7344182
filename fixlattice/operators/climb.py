"""Every name of a log located in the lattice, its next closure, and rung steps: one query for all names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixlattice.functions import lattice as L
from fixlattice.functions.dims import COOLING, LADDER, nth
from fixlattice.operators import log as G
from fixlattice.operators.checks import validate_stack

#: The evidence column of ``operators.log.evidence`` that decides each closure; a rung is decided by the state itself.
EVIDENCE = {"execution": "has_identity", "testing": "has_tests", "observation": "n_nodes", "independent_witnessing": "n_external", "provenance": "provenance", "append_only_crystallization": "n_nodes", "review": "n_external", "graph_identity": "has_identity", "rung": "state"}
_WITNESSING = 1 << COOLING.index("independent_witnessing")


def node_states(log: DataFrame) -> DataFrame:
    """(name, level, w, r, ...evidence): independent witnessing comes from external records alone; names of witnesses only are at the bottom."""
    return located(G.evidence(log))


def located(evidence: DataFrame) -> DataFrame:
    """node_states from evidence as ``operators.log.evidence``, or a stream of it, gives it."""
    found = G.rites(evidence)
    level = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LADDER]), F.coalesce("level_name", F.lit("function"))) - 1, F.lit(0)).cast("int")
    external = F.col("n_external") > 0
    w = F.col("cooled").bitwiseAND(~_WITNESSING & L.ALL_COOLING) + F.when(external, _WITNESSING).otherwise(0)
    has = F.col("n_nodes") > 0
    return found.withColumns({"level": F.when(has, level).otherwise(0), "w": F.when(has, w).otherwise(0).cast("bigint"), "r": F.when(has, F.col("r")).otherwise(0)})


def positions(log: DataFrame) -> DataFrame:
    """(name, level, w, r, distance, next_kind, next_name, requires); requires: the evidence that decides the next closure."""
    return positions_of(node_states(log))


def positions_of(s: DataFrame) -> DataFrame:
    """positions from node_states."""
    kind, name = L.next_closure(F.col("level"), F.col("w"), F.col("r"))
    wanted = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])
    out = s.select("name", "level", "w", "r", L.distance(F.col("level"), F.col("w"), F.col("r")).alias("distance"), kind.alias("next_kind"), name.alias("next_name"))
    return out.withColumn("requires", wanted[F.when(F.col("next_kind") == "rung", "rung").otherwise(F.col("next_name"))])


def step(log: DataFrame, witness: str) -> DataFrame:
    """One step for each name that has node records: rung steps as records to append, all others as refusals."""
    at = positions(log).select("name", "level", "next_kind", "next_name")
    own = G.latest(log, witnesses=False).join(at, "name")
    rung = F.col("next_kind") == "rung"
    move = F.concat(F.lit("transition:"), nth(LADDER, F.col("level")), F.lit("->"), F.col("next_name"), F.lit(f":by:{witness}"))
    return own.withColumns(
        {
            "realization_level": F.when(rung, F.col("next_name")).otherwise(F.col("realization_level")),
            "provenance": F.when(rung, F.concat(F.coalesce("provenance", F.array().cast("array<string>")), F.array(move))).otherwise(F.col("provenance")),
            "status": F.when(rung, "ok").otherwise("refused"),
            "reason": F.when(F.col("next_kind") == "fixpoint", "at_fixpoint").when(~rung, F.concat(F.lit("derived_only:"), F.col("next_name"))),
        }
    )


def gauge(log: DataFrame, rings: DataFrame | None = None, base: list[str] = ()) -> DataFrame:
    """(name, seven booleans): the steps that a run over each name's own records can claim.

    rings (name, depth, adds, requires, accesses): declared relations; they must stack up for relational_validation. A name that declares none has none that fail.
    """
    e = G.evidence(log).where("n_nodes > 0")
    related = F.lit(True)
    if rings is not None:
        found = validate_stack(rings.withColumnRenamed("name", "_of"), "_of", list(base)).select(F.col("_of").alias("name"), (F.col("status") == "ok").alias("_stacks"))
        e, related = e.join(found, "name", "left"), F.coalesce("_stacks", F.lit(True))
    return e.select(
        "name",
        F.col("has_identity").alias("execution"),
        (F.col("has_tests") & F.col("tested")).alias("testing"),
        related.alias("relational_validation"),
        (F.col("n_nodes") > 0).alias("observation"),
        (F.col("n_external") > 0).alias("independent_witnessing"),
        F.coalesce(F.size(F.array_distinct("provenance")) >= 2, F.lit(False)).alias("provenance"),
        (F.col("n_nodes") > 1).alias("append_only_crystallization"),
    )
