"""Nearest neighbours within batches, and sums over them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.functions.hashing import leading_bits, order_key
from textanomaly.functions.vectors import as_double, matrix, times_rows
from textanomaly.session import attach, small_side


def batch_counts(df: DataFrame, keys: list[str], batch_size: int) -> DataFrame:
    """``batches`` = ``ceil(rows / batch_size)`` for every key."""
    batches = F.ceil(F.count(F.lit(1)) / F.lit(batch_size))
    return df.groupBy(*keys).agg(F.greatest(batches, F.lit(1)).cast("long").alias("batches"))


def hash_batches(
    df: DataFrame,
    keys: list[str],
    batch_size: int,
    seed: int = 0,
    id_col: str = "doc_id",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``batch``: every key is spread over its ``batch_counts`` by a hash of the id.

    A key of at most ``batch_size`` rows is one batch; a larger one, however hot,
    gives batches of about that size.
    """
    if counts is None:
        counts = small_side(batch_counts(df, keys, batch_size))
    spread = leading_bits(order_key(seed, "batch", F.col(id_col)))
    return attach(df, counts, keys).withColumn("batch", F.pmod(spread, F.col("batches"))).drop("batches")


def nearest_pairs(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and exact distances of the ``min(k, n)`` nearest rows of every row.

    One matrix product finds the candidates: all pairs within its rounding error
    of the k-th distance. Only those are measured by differences, so ranks and
    ties are exact.
    """
    n, dim = x.shape
    kept = min(k, n)
    squares = np.einsum("ij,ij->i", x, x)
    rough = squares[:, None] + squares[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(rough, np.inf)
    slack = 8 * (dim + 4) * np.finfo(np.float64).eps * (squares.max() + squares)
    limit = np.partition(rough, kept - 1, axis=1)[:, kept - 1] + slack
    rows, others = np.nonzero(rough <= limit[:, None])
    dist = np.empty(len(rows))
    step = max(1, (16 << 20) // (8 * dim))
    for at in range(0, len(rows), step):
        gap = x[rows[at : at + step]] - x[others[at : at + step]]
        dist[at : at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    dist[rows == others] = np.inf
    order = np.lexsort((others, dist, rows))
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows are sorted
    order = order[place < kept]
    return rows[order], others[order], dist[order]


def knn(
    df: DataFrame,
    keys: list[str],
    k: int = 5,
    batch_size: int = 1000,
    seed: int = 0,
    id_col: str = "doc_id",
    vector: str = "embedding",
) -> DataFrame:
    """``min(k, batch rows)`` nearest rows of the same batch by Euclidean distance.

    The distance to itself is infinite, so a row names itself only, and last,
    when the batch has no more than k rows. Ties go to the smaller id. Batches
    are bounded (``hash_batches``), and only the k kept pairs leave a batch.
    """
    batched = hash_batches(df.select(*keys, id_col, vector), keys, batch_size, seed, id_col)
    group = [*keys, "batch"]
    fields = [batched.schema[c] for c in group]
    identity = df.schema[id_col].dataType
    schema = T.StructType(
        [
            *fields,
            T.StructField("id", identity),
            T.StructField("nbr", identity),
            T.StructField("rank", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        ids = pdf[id_col].to_numpy()
        rows, others, dist = nearest_pairs(np.stack(pdf[vector].to_numpy()).astype(np.float64), k)
        kept = min(k, len(ids))
        out = pd.DataFrame(
            {"id": ids[rows], "nbr": ids[others], "rank": np.tile(np.arange(1, kept + 1), len(ids)), "dist": dist}
        )
        for column in group:
            out[column] = pdf[column].iloc[0]
        return out[[f.name for f in schema.fields]]

    return batched.groupBy(*group).applyInPandas(nearest, schema)


def neighbour_sum(
    df: DataFrame,
    nbrs: DataFrame,
    weights: Sequence[Sequence[float]] | None = None,
    id_col: str = "doc_id",
    vector: str = "embedding",
) -> DataFrame:
    """Sum of the neighbours' vectors, each first multiplied by ``weights`` if given.

    ``nbrs(id, nbr)`` is a neighbour table; ``weights`` is features x outputs. The
    product comes before the join, so the narrower vectors are shuffled.
    """
    value = as_double(F.col(vector))
    if weights is not None:
        value = times_rows(value, matrix(np.asarray(weights).T.tolist()))
    vectors = df.select(F.col(id_col).alias("nbr"), value.alias("v"))
    total = Summarizer.sum(array_to_vector("v"))
    return (
        nbrs.select("id", "nbr")
        .join(vectors, "nbr")
        .groupBy("id")
        .agg(vector_to_array(total).alias("local_sum"))
    )
