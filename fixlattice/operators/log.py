"""Views of an append-only log: latest, history, witnesses, evidence, registry, forks. One grouped pass each, never a scan a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.functions.dims import RITES
from fixlattice.sources.log_store import EVIDENCE


def latest(log: DataFrame, witnesses: bool = True) -> DataFrame:
    """The last record of each name; with ``witnesses`` of any kind, else of nodes alone. Combined before the shuffle."""
    kept = log if witnesses else log.where("kind <> 'witness'")
    rest = [c for c in log.columns if c != "name"]
    return kept.groupBy("name").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("name", *[F.col(f"r.{c}").alias(c) for c in rest])


def history(log: DataFrame, name: str) -> DataFrame:
    return log.where(F.col("name") == name).orderBy("seq")


def is_external(witness_id: Column) -> Column:
    """Not a re-run of the process itself; a record without an id counts as external."""
    return ~F.coalesce(witness_id, F.lit("")).startswith("process_rerun")


def external_witnesses(log: DataFrame) -> DataFrame:
    return log.where((F.col("kind") == "witness") & is_external(F.col("witness_id")))


def accept_witness(df: DataFrame) -> DataFrame:
    """(name, witness_id) requests with status and reason; accepted rows are witness records."""
    bad = (F.coalesce("witness_id", F.lit("")) == "") | F.col("witness_id").startswith("process_rerun")
    return df.withColumns({"kind": F.lit("witness"), "status": F.when(bad, "refused").otherwise("ok"), "reason": F.when(bad, "not_external")})


def evidence(log: DataFrame) -> DataFrame:
    """For each name: what its own records and witnesses show. One grouping of the log."""
    node = F.col("kind") != "witness"
    at = F.when(node, F.col("seq"))

    def last(c: str) -> Column:
        return F.max_by(c, at)

    def some(c: str) -> Column:
        return F.coalesce(F.size(last(c)) > 0, F.lit(False))

    passes = F.flatten(F.coalesce("golden_history", F.array().cast("array<array<string>>")))
    return log.groupBy("name").agg(
        F.sum(F.when(node, 1).otherwise(0)).alias("n_nodes"),
        last("realization_level").alias("level_name"),
        some("generated_documentation").alias("has_docs"),
        some("tests").alias("has_tests"),
        some("generated_packages").alias("has_packages"),
        F.coalesce(last("graph_identity") != "", F.lit(False)).alias("has_identity"),
        F.count_distinct(F.when(node & (F.col("graph_identity") != ""), F.col("graph_identity"))).alias("n_identities"),
        F.coalesce(F.bool_or(F.when(node, F.array_contains(passes, "testing"))), F.lit(False)).alias("tested"),
        F.coalesce(F.bit_or(F.when(node, cooled_steps(passes))), F.lit(0)).alias("cooled"),
        F.sum(F.when((F.col("kind") == "witness") & is_external(F.col("witness_id")), 1).otherwise(0)).alias("n_external"),
        last("provenance").alias("provenance"),
    )


def cooled_steps(passes: Column) -> Column:
    """The mask of the steps among passes."""
    from fixlattice.functions.dims import COOLING, mask_of

    return mask_of(passes, COOLING)


def rites(found: DataFrame) -> DataFrame:
    """evidence with r: the mask of rites granted, each against the node's own records."""
    checks = {
        "explanation": F.col("has_docs"),
        "evolution": F.col("n_identities") >= 2,
        "testing": F.col("has_tests") & F.col("tested"),
        "export": F.col("has_packages"),
        "review": F.col("n_external") > 0,
        "graph_identity": F.col("has_identity"),
    }
    total = F.lit(0)
    for i, rite in enumerate(RITES):
        total = total + F.when(checks[rite], 1 << i).otherwise(0)
    return found.withColumn("r", total.cast("bigint"))


def registry_new(candidates: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose id no record has, each id once (the first by pos)."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    return first.join(seen.select(key).distinct(), key, "left_anti")


def bestiary(genomes: DataFrame) -> DataFrame:
    """Ids whose last verdict is REJECT."""
    return genomes.groupBy("id").agg(F.max_by("verdict", "seq").alias("verdict")).where("verdict = 'REJECT'").select("id")


def fork(log: DataFrame, coordinate: str, witness: str, names: DataFrame | None = None) -> DataFrame:
    """The last node record of each name under ``name@coordinate``, without evidence. Names that have none are refused rows."""
    own = latest(log, witnesses=False)
    if names is not None:
        own = names.join(own, "name", "left")
    refused = F.lit(not witness) | F.col("seq").isNull()
    none = F.array().cast("array<string>")
    return own.select(
        "seq", F.concat("name", F.lit("@" + coordinate)).alias("name"), "kind", "python_path", "graph_identity", "realization_level",
        F.array(F.concat(F.lit("fork:"), F.col("name"), F.lit(f"->{coordinate}:by:{witness}"))).alias("provenance"),
        *[none.alias(c) for c in EVIDENCE], F.array().cast("array<array<string>>").alias("golden_history"),
        F.when(refused, "refused").otherwise("ok").alias("status"), F.when(F.lit(not witness), "empty_witness").when(F.col("seq").isNull(), "no_record").alias("reason"),
    )


def promote(champions: DataFrame, log: DataFrame) -> DataFrame:
    """champions (name) with promoted: whether an external witness accepted it."""
    seen = external_witnesses(log).select("name").distinct().withColumn("promoted", F.lit(True))
    return champions.join(seen, "name", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))
