"""Tables and SQL pieces several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textanomaly.session import ensure_checkpoint_dir

SEED = 7
DIM = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder next to the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("label"), "text")


def vector_corpus(spark: SparkSession, folder: str) -> DataFrame:
    split = F.when(F.col("vec_id") % 2 == 0, "train").otherwise("test")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label", split.alias("split")
    )


def vector_hierarchy(corpus: DataFrame) -> DataFrame:
    """Labels in threes under a parent, and the last one alone."""
    parent = F.when(F.col("label") == 9, 3).otherwise(F.floor(F.col("label") / 3)).cast("int")
    return corpus.select("label").distinct().withColumn("parent", parent)


CORPUS = """corpus as (
  select vec_id as doc_id, embedding::double[] as embedding, label,
         case when vec_id % 2 = 0 then 'train' else 'test' end as split
  from embeddings)"""
HIERARCHY = """hierarchy as (
  select label, case when label = 9 then 3 else label // 3 end as parent
  from (select distinct label from embeddings))"""


def order_sql(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def bits_sql(key: str) -> str:
    return f"('0x' || substr({key}, 1, 15))::bigint"


def rounded(*names: str, digits: int = 6) -> dict:
    return {n: F.round(F.col(n), digits) for n in names}
