"""Loss measures as aggregates over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.functions.vectors import absolute_distance, as_double, matrix, squared_distance, times_rows

# Accepted names of the row norms.
NORMS = {
    "squared": ["MSE", "mse", "Frob", "F"],
    "absolute": ["L1", "l1"],
    "euclidean": ["LAD", "lad", "L21", "l21", "L2", "l2"],
}


def norm_family(kind: str) -> str:
    for family, names in NORMS.items():
        if kind in names:
            return family
    raise ValueError(f"unknown norm {kind}")


def row_error(x: Column, y: Column, kind: str) -> Column:
    family = norm_family(kind)
    if family == "absolute":
        return absolute_distance(as_double(x), as_double(y))
    squared = squared_distance(as_double(x), as_double(y))
    return squared if family == "squared" else F.sqrt(squared)


def recon_error(df: DataFrame, x: str, xhat: str, kind: str = "MSE", keys: list[str] | None = None) -> DataFrame:
    """Mean row error between two vector columns, over the table or by key."""
    error = row_error(F.col(x), F.col(xhat), kind)
    return df.groupBy(*(keys or [])).agg(F.avg(error).alias("error"))


def subspace_error(
    df: DataFrame,
    y: str,
    z: str,
    weights: Sequence[Sequence[float]],
    kind: str = "MSE",
    keys: list[str] | None = None,
) -> DataFrame:
    """Mean row error between ``y`` and ``z`` mapped back by the transposed ``weights``."""
    back = times_rows(as_double(F.col(z)), matrix(weights))
    return df.withColumn("__back", back).transform(lambda d: recon_error(d, y, "__back", kind, keys))


def ortho_error(df: DataFrame, row: str = "i", column: str = "j", value: str = "v") -> DataFrame:
    """Mean squared entry of ``AᵀA - I`` for a matrix stored as (i, j, v) cells.

    A matrix row is gathered once; its outer product is summed inside the scan,
    so only columns² partial sums a task are shuffled.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.col(column).alias("j"), F.col(value).cast("double").alias("v"))))
    rows = df.groupBy(row).agg(cells.alias("cells"))
    gram = (
        rows.select("cells", F.explode("cells").alias("left"))
        .select("left", F.explode("cells").alias("right"))
        .groupBy(F.col("left.j").alias("a"), F.col("right.j").alias("b"))
        .agg(F.sum(F.col("left.v") * F.col("right.v")).alias("g"))
    )
    gap = F.col("g") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    # cells never seen together have a zero product and lie off the diagonal
    width = F.count_if(F.col("a") == F.col("b"))
    return gram.agg((F.sum(gap * gap) / (width * width)).alias("error"))
