"""Exact interpolated quantiles by group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.operators.ranges import ranges_needed, with_range
from textanomaly.session import attach, small_side


def quantile(
    df: DataFrame, keys: list[str], value: str, q: float, out: str = "quantile", ranges: int | None = None
) -> DataFrame:
    """Linear-interpolated quantile ``q`` of ``value`` by key; nulls are ignored.

    The built-in aggregate holds a group's distinct values in one task and serves
    groups that fit (``ranges`` = 1). Larger ones are split: rows are counted by
    value range (combined in the scan), the one or two ranges holding the wanted
    ranks are found, and only their rows are sorted. By default the largest group
    decides the number of ranges.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    ranges = ranges or ranges_needed(data, keys)
    if ranges == 1:
        return data.groupBy(*keys).agg(F.percentile("__v", F.lit(float(q))).alias(out))

    placed = with_range(data, keys, "__v", ranges)
    counts = small_side(placed.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("__n")))
    running = Window.partitionBy(*keys).orderBy("range")
    position = (F.sum("__n").over(Window.partitionBy(*keys)) - 1) * F.lit(float(q))
    located = (
        counts.withColumn("__start", F.sum("__n").over(running) - F.col("__n"))
        .withColumn("__pos", position)
        .withColumn("__lo", F.floor("__pos"))
        .withColumn("__hi", F.ceil("__pos"))
        .where((F.col("__start") <= F.col("__hi")) & (F.col("__start") + F.col("__n") > F.col("__lo")))
        .select(*keys, "range", "__start", "__pos", "__lo", "__hi")
    )
    wanted = attach(placed, small_side(located), [*keys, "range"])
    values = wanted.groupBy(*keys, "range", "__start", "__pos", "__lo", "__hi", "__v").agg(
        F.count(F.lit(1)).alias("__n")
    )
    inside = Window.partitionBy(*keys, "range").orderBy("__v")
    last = F.col("__start") + F.sum("__n").over(inside) - 1
    ends = values.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__n") + 1)

    def at(rank: str):
        return F.max(F.when(F.col(rank).between(F.col("__first"), F.col("__last")), F.col("__v")))

    found = ends.groupBy(*keys).agg(
        at("__lo").alias("__a"), at("__hi").alias("__b"), F.max(F.col("__pos") - F.col("__lo")).alias("__f")
    )
    return found.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias(out))
