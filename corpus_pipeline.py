"""Raw documents to packed training sequences, in five stages.

Each stage reads what the stage before has written as Parquet and covers all of it; all but the last return
the columns of documents, whatever further columns there are and whatever their names.

Null and empty texts have no words: the first stage rejects them; called on their own, the second keeps one of them, the third leaves them alone,
the fourth gives them the bias's posterior and the fifth a sequence of the end id alone. Very long texts are read whole. Repeated rows are documents of their own: the
first stage judges them alike, the second keeps one. Ties: as the operators' modules say. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fixlattice.llm import disclosure, mixing, packing, quality, simhash
from fixlattice.llm.store import result, scratch
from fixlattice.llm.text import public_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or line frequency reject go; the frequent lines of the others go, and n_chars follows."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id: SimHash of five words within 4 bits, or Jaccard similarity of 0.8."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised; n_chars follows."""
    return disclosure.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic domains are mixed out; all others keep the tokens they have."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.take_nearest(docs, labels, mixing.label_domain())


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("packing", packed_sequences),
]

#: SQL expresses neither SimHash links nor the fitted mixture: the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = result(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
