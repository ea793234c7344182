"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlattice.llm import exponion, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.weighted_sampling import compare_with_edited

    return compare_with_edited(_table(spark, sf_dir, "documents"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm import mixing

    table, names, _, _ = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), mixing.label_domain(), mixing.TARGETS)
    likely = F.get(F.array(*[F.lit(x) for x in names]), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    toxic = sum((F.get("posterior", F.lit(k)) for k, x in enumerate(names) if x in mixing.TOXIC), F.lit(0.0))
    return table.select("doc_id", "n_tokens", likely.alias("domain"), F.array_max("posterior").alias("probability"), toxic.alias("toxic_probability"), "rate")


def op3_prediction_by_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.ppm import score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.text import public_vocabulary
    from fixlattice.llm.token_files import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    parts = write_token_files(_table(spark, sf_dir, "documents"), folder, public_vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_token_files(parts, folder, ids=False)


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.sharding import place

    placed = place(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.text import public_vocabulary
    from fixlattice.llm.token_counts import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.packing import pack_documents
    from fixlattice.llm.text import public_vocabulary

    return pack_documents(_table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"), end_id=1)


def op10_information_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.disclosure import digest, find

    return digest(find(_table(spark, sf_dir, "documents")))


def op11_ownership_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.secret_scans import digest, scan

    # a source is an owner; what it has in one language is a repository
    return digest(scan(_table(spark, sf_dir, "documents"), owner="source", repository="lang"))


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.with_inertia(*exponion.cluster(_table(spark, sf_dir, "embeddings")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixlattice.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_weighted_sampling": op1_weighted_sampling,
    "op2_soft_membership": op2_soft_membership,
    "op3_prediction_by_partial_matching": op3_prediction_by_partial_matching,
    "op4_token_files": op4_token_files,
    "op5_simhash_pivots": op5_simhash_pivots,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_line_frequency": op7_line_frequency,
    "op8_section_tokens": op8_section_tokens,
    "op9_residual_packing": op9_residual_packing,
    "op10_information_disclosure": op10_information_disclosure,
    "op11_ownership_frequency": op11_ownership_frequency,
    "op12_exponion": op12_exponion,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op7_line_frequency": quality.ORACLE, "op12_exponion": exponion.ORACLE}
