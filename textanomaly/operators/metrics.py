"""Ranking metrics by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.operators.ranges import ranges_needed, with_range
from textanomaly.session import attach, small_side


def ranking_metrics(
    df: DataFrame,
    keys: list[str],
    y: str = "y",
    score: str = "score",
    ranges: int | None = None,
) -> DataFrame:
    """``auc`` (ties count half) and ``ap`` (sum of precision over recall steps) by key.

    ``auc`` is null for a group of one class, ``ap`` for a group without positives.
    Rows are first added up by distinct score. With ``ranges`` = 1 a group is
    ranked whole in one task, which suits groups of bounded size: rows are shuffled
    once, by key. Otherwise it is
    ranked within that many value ranges and the totals of the other ranges are
    added from a small table, so a group holding a large share of all rows is
    spread over many tasks. By default the largest group decides.
    """
    data = df.select(*keys, F.col(score).cast("double").alias("__s"), F.col(y).cast("long").alias("__y"))
    data = data.where(F.col("__s").isNotNull())
    if ranges == 1 and keys:
        data = data.repartition(*keys)
    totals = [F.sum("__y").alias("p"), F.count(F.lit(1)).alias("n")]
    ranges = ranges or ranges_needed(data, keys)
    if ranges == 1:
        placed = data.withColumn("range", F.lit(0))
    else:
        placed = with_range(data, keys, "__s", ranges)
    cell = [*keys, "range"]
    by_score = placed.groupBy(*cell, "__s").agg(*totals)

    whole = Window.partitionBy(*cell)
    downward = whole.orderBy(F.col("__s").desc())
    p, n = F.col("p"), F.col("n")
    ranked = by_score.withColumns(
        {
            "cp": F.sum(p).over(downward),
            "cn": F.sum(n).over(downward),
            "kp": F.sum(p).over(whole),
            "kn": F.sum(n).over(whole),
        }
    )
    if ranges == 1:
        offsets = {"above_p": F.lit(0), "above_n": F.lit(0), "tp": F.col("kp"), "tn": F.col("kn")}
        ranked = ranked.withColumns(offsets)
    else:
        sums = placed.groupBy(*cell).agg(F.sum("__y").alias("rp"), F.count(F.lit(1)).alias("rn"))
        group = Window.partitionBy(*keys)
        higher = group.orderBy(F.col("range").desc())
        side = small_side(sums).select(
            *cell,
            (F.sum("rp").over(higher) - F.col("rp")).alias("above_p"),
            (F.sum("rn").over(higher) - F.col("rn")).alias("above_n"),
            F.sum("rp").over(group).alias("tp"),
            F.sum("rn").over(group).alias("tn"),
        )
        ranked = attach(ranked, side, cell)
    seen_p, seen_n = F.col("cp") + F.col("above_p"), F.col("cn") + F.col("above_n")
    below = (F.col("tn") - F.col("tp")) - (seen_n - seen_p)
    pairs = p * (below + F.lit(0.5) * (n - p))
    gain = p.cast("double") / F.nullif(F.col("tp"), F.lit(0)) * seen_p / seen_n
    possible = F.max("tp").cast("double") * (F.max("tn") - F.max("tp"))
    return ranked.groupBy(*keys).agg(
        (F.sum(pairs) / F.nullif(possible, F.lit(0.0))).alias("auc"), F.sum(gain).alias("ap")
    )


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", **options) -> DataFrame:
    return ranking_metrics(df, keys, y, score, **options).drop("ap")


def average_precision(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", **options) -> DataFrame:
    return ranking_metrics(df, keys, y, score, **options).drop("auc")


def summary(results: DataFrame) -> DataFrame:
    """Mean metrics by model."""
    return results.groupBy("model").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))
