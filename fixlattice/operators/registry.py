"""Genomes and champions as records of the log: a registry that is reloaded from it, and promotion by external witnesses alone.

A record's own fields go as JSON into ``payload``; its name is the genome's id. Of several records of one id the last counts. Nulls stay null; an empty log is an empty registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixlattice.operators.log import external_witnesses

GENOME, CHAMPION = "gp_genome", "gp_champion"
_GENOME = "ops string, proposed_by string, parents array<string>, fitness double, verdict string"
_CHAMPION = "ops string, fitness double"


def _fields(ddl: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in ddl.split(",")]


def _record(df: DataFrame, kind: str, fields: list[str], provenance: Column) -> DataFrame:
    own = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return df.select(F.col("id").alias("name"), F.lit(kind).alias("kind"), F.array(provenance).alias("provenance"), F.to_json(F.struct(*own)).alias("payload"), *[c for c in ("at",) if c in df.columns])


def genome_records(scored: DataFrame) -> DataFrame:
    """Scored genomes (id, ops, proposed_by, parents, fitness, verdict; all but id and verdict may be missing) as log records."""
    by = F.coalesce("proposed_by", F.lit("unknown")) if "proposed_by" in scored.columns else F.lit("unknown")
    return _record(scored, GENOME, _fields(_GENOME), F.concat(F.lit("scored:"), by))


def champion_records(champions: DataFrame) -> DataFrame:
    """Champions (id, ops, fitness, proposed_by) as log records: gauged, which grants nothing."""
    by = F.coalesce("proposed_by", F.lit("unknown")) if "proposed_by" in champions.columns else F.lit("unknown")
    return _record(champions, CHAMPION, _fields(_CHAMPION), F.concat(F.lit("gauged:"), by))


def registry(log: DataFrame) -> DataFrame:
    """(id, seq, ops, proposed_by, parents, fitness, verdict) of every genome in a log, the last record of each."""
    last = log.where(F.col("kind") == GENOME).groupBy("name").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))
    return last.select(F.col("name").alias("id"), "seq", F.from_json("payload", _GENOME).alias("g")).select("id", "seq", "g.*")


def promotions(log: DataFrame) -> DataFrame:
    """(id, gauged, promoted, pending) of every champion in a log: promoted if an external witness has accepted its id."""
    champions = log.where(F.col("kind") == CHAMPION).groupBy(F.col("name").alias("id")).agg(F.lit(True).alias("gauged"))
    seen = external_witnesses(log).select(F.col("name").alias("id")).distinct().withColumn("_seen", F.lit(True))
    promoted = F.coalesce("_seen", F.lit(False))
    return champions.join(seen, "id", "left").select("id", "gauged", promoted.alias("promoted"), F.when(~promoted, "external_acceptance").alias("pending"))
