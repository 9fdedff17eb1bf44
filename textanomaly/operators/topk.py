"""First k rows of every group in a seeded order, whatever the group sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.functions.hashing import HASH_BITS, magnitude
from textanomaly.session import attach, small_side


def first_k(df: DataFrame, keys: list[str], order: str, k: int, tie: list[str], rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k within ``keys`` by the hexadecimal ``order`` key, then ``tie``.

    A ranking window alone would sort a hot group in one task. Order keys are
    uniform, so a histogram of their bit lengths (at most 61 cells a group, fully
    combined before the shuffle) gives the smallest cut holding k rows; the scan
    then drops everything above it, leaving about 2k rows a group for the window.
    The cut is exact: it never removes one of the first k.
    """
    cell = magnitude(F.col(order))
    histogram = df.groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    running = Window.partitionBy(*keys).orderBy("__cell")
    cuts = (
        histogram.withColumn("__below", F.sum("__n").over(running))
        .groupBy(*keys)
        .agg(F.coalesce(F.min(F.when(F.col("__below") >= k, F.col("__cell"))), F.lit(HASH_BITS)).alias("__cut"))
    )
    kept = attach(df, small_side(cuts), keys).where(cell <= F.col("__cut")).drop("__cut")
    return ranked(kept, keys, order, k, tie, rank)


def ranked(df: DataFrame, keys: list[str], order: str, k: int, tie: list[str], rank: str = "rank") -> DataFrame:
    """Plain ranking window, for groups already known to be small."""
    window = Window.partitionBy(*keys).orderBy(F.col(order), *[F.col(t) for t in tie])
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
