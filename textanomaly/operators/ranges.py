"""Splitting a sorted column into value ranges, so no task sorts a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.session import attach, small_side


# About as many rows as one task should sort.
ROWS_PER_RANGE = 1_000_000
# A group's edges travel with its rows while these are placed (8 bytes an edge); more ranges are made by levels.
MAX_RANGES = 4096


def ranges_needed(df: DataFrame, keys: list[str]) -> int:
    """How many ranges the largest group should be split into; 1 if it fits a task."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    return max(1, math.ceil(largest / ROWS_PER_RANGE))


def with_range(df: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """Add ``range``: a number that grows with the value, about ``ranges`` of them in the largest group.

    Edges only balance the work; any monotone numbering gives the same results.
    More than ``MAX_RANGES`` are made by levels: the ranges of a level that are
    still too large for a task are split again by edges of their own, so neither
    a group's size nor the length of a row's list of edges is bounded by the other.
    """
    placed = _placed(df, keys, value, min(ranges, MAX_RANGES), "range")
    left = math.ceil(ranges / MAX_RANGES)
    while left > 1:
        cell = [*keys, "range"]
        sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
        large = small_side(sizes.where(F.col("__n") > ROWS_PER_RANGE).select(*cell, F.lit(True).alias("__large")))
        marked = attach(placed, large, cell, "left")
        parts = min(left, MAX_RANGES)
        placed = _placed(marked, cell, value, parts, "__inner", F.col("__large"))
        placed = placed.withColumn("range", F.col("range") * max(4, parts) + F.col("__inner")).drop("__inner", "__large")
        left = math.ceil(left / MAX_RANGES)
    return placed


def _placed(df: DataFrame, keys: list[str], value: str, ranges: int, name: str, where: Column | None = None) -> DataFrame:
    """Add ``name``: how many of the group's approximate quantile edges the value reaches; 0 for rows not in ``where``.

    Edges are computed once, since approximate quantiles may differ between two
    runs of the same plan. A value is placed by a coarse and a fine comparison,
    about ``2 * sqrt(ranges)`` steps.
    """
    side = max(2, math.isqrt(ranges))
    shares = [i / (side * side) for i in range(1, side * side)]
    edges = (df if where is None else df.where(where)).groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 20 * side * side).alias("__edges")
    )
    joined = attach(df, small_side(edges), keys, "inner" if where is None else "left")
    x = F.col(value).cast("double")

    def reached(part: Column) -> Column:
        return F.size(F.filter(part, lambda e: e <= x))

    coarse_edges = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get(F.col("__edges"), i * side - 1))
    coarse = F.when(F.col("__edges").isNull(), 0).otherwise(reached(coarse_edges))
    counted = joined.withColumn("__coarse", coarse)
    fine = reached(F.slice("__edges", F.col("__coarse") * side + 1, F.lit(side - 1)))
    fine = F.when(F.col("__edges").isNull(), 0).otherwise(fine)
    return counted.withColumn(name, (F.col("__coarse") * side + fine).cast("long")).drop("__edges", "__coarse")
