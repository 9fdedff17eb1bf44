"""Scaling of vectors and columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.functions.vectors import as_double
from textanomaly.session import attach, small_side


def fit_scaler(df: DataFrame, keys: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Mean and population deviation of every feature, one row a key.

    The vectors are summarised where they lie and only the summaries are shuffled.
    """
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(as_double(F.col(vector))))
    n = F.col("s.count").cast("double")
    return (
        df.groupBy(*(keys or []))
        .agg(summary.alias("s"))
        .select(
            *(keys or []),
            vector_to_array(F.col("s.mean")).alias("mu"),
            # the summary's variance divides by n - 1
            F.transform(vector_to_array(F.col("s.variance")), lambda v: F.sqrt(v * (n - 1) / n)).alias("sigma"),
        )
    )


def apply_scaler(
    df: DataFrame, scaler: DataFrame, keys: list[str] | None = None, vector: str = "embedding"
) -> DataFrame:
    """Standardise ``vector`` with a fitted scaler; a zero deviation divides by 1."""
    joined = attach(df, small_side(scaler), keys or [])
    centred = F.zip_with(as_double(F.col(vector)), F.col("mu"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("sigma"), lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))
    return joined.withColumn(vector, scaled).drop("mu", "sigma")


def minmax(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """``(x - min) / (max - min)`` over the whole column (or key); null if constant.

    A column of arrays is scaled by the extremes over all its entries.
    """
    keys = keys or []
    is_array = df.schema[column].dataType.typeName() == "array"
    low = F.array_min(column) if is_array else F.col(column)
    high = F.array_max(column) if is_array else F.col(column)
    limits = df.groupBy(*keys).agg(
        F.min(low).cast("double").alias("__low"), F.max(high).cast("double").alias("__high")
    )
    joined = attach(df, small_side(limits), keys)

    def scaled(x):
        return (x.cast("double") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))

    value = F.transform(column, scaled) if is_array else scaled(F.col(column))
    return joined.withColumn(column, value).drop("__low", "__high")
