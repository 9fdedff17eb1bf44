"""A corpus made ready for training: stages over ``documents``, each written as Parquet and read again.

Every stage works on all that its predecessor kept and returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textanomaly.llm import classifier, decontaminate, mixing, pii, simhash
from textanomaly.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have the score of no words; equal texts go or stay together. Own columns named like the
    classifier's stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = {name: f"__own_{name}" for name in ("held_out", "score", "predicted") if name in docs.columns}
    kept = classifier.classify(docs.withColumnsRenamed(own), labels).where("predicted = 1")
    kept = kept.drop("held_out", "score", "predicted").withColumnsRenamed({hidden: name for name, hidden in own.items()})
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest doc_id, of repeated rows one.

    Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts hold none and stay."""
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and mail names replaced by pseudonyms; null texts stay null, no row goes."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken, a null source is one of its own."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_values", private_values),
    ("mixture", mixture),
]
# a trained classifier and keyed permutations aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
