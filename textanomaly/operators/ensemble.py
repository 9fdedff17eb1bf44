"""Standardising and combining detector scores; thresholds and decisions.

Scores are long tables ``(*keys, doc_id, detector_id, score)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.detectors.spec import DetectorSpec
from textanomaly.functions.hashing import leading_bits, order_key
from textanomaly.operators.quantile import quantile
from textanomaly.session import attach, settle, small_side


def score_matrix(scores: DataFrame, detectors: list[str | int], rows: list[str]) -> DataFrame:
    """One column a detector, one line a row; a single shuffle of partly filled lines."""
    cells = [F.max(F.when(F.col("detector_id") == d, F.col("score"))).alias(str(d)) for d in detectors]
    return scores.groupBy(*rows).agg(*cells)


def fit_score_scaler(train_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of every detector's training scores."""
    return train_scores.groupBy(*keys, "detector_id").agg(
        F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma")
    )


def apply_score_scaler(scores: DataFrame, scaler: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``z``; a zero deviation divides by 1."""
    joined = attach(scores, small_side(scaler), [*keys, "detector_id"])
    spread = F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma"))
    return joined.withColumn("z", (F.col("score") - F.col("mu")) / spread).drop("mu", "sigma")


def combine(scores: DataFrame, rows: list[str], how: str = "median", value: str = "z") -> DataFrame:
    """One score a row from all its detectors: ``average``, ``maximisation``, else the median.

    A group here is one row's detectors, so it is as wide as the ensemble.
    """
    if how == "average":
        merged = F.avg(value)
    elif how == "maximisation":
        merged = F.max(value)
    else:
        merged = F.percentile(value, F.lit(0.5))
    return scores.groupBy(*rows).agg(merged.alias("score"))


def draw_detectors(scores: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """``draws(draw, slot, detector_id)``: for every size n, n detectors with replacement.

    ``draw`` is the size itself. The detectors are those present in ``scores``.
    """
    detectors = settle(scores.select("detector_id").distinct())
    listed = detectors.agg(F.array_sort(F.collect_list("detector_id")).alias("ids"))
    numbered = listed.select(F.posexplode("ids").alias("at", "detector_id"))
    count = detectors.agg(F.count(F.lit(1))).scalar()
    sized = listed.select(F.explode(F.array(*[F.lit(n) for n in sizes])).alias("draw"))
    slots = sized.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("draw") - 1)))
    picked = leading_bits(order_key(seed, "draw", F.col("draw"), F.col("slot")))
    return slots.withColumn("at", F.pmod(picked, count).cast("int")).join(numbered, "at").drop("at")


def sub_ensemble(
    z_scores: DataFrame,
    rows: list[str],
    draws: DataFrame,
    how: str = "median",
) -> DataFrame:
    """Scores of sub-ensembles drawn with replacement, without scoring anything again.

    ``draws(draw, slot, detector_id)`` lists each draw's detectors; a detector
    drawn twice counts twice, one that a row has no score of doesn't count (a draw
    of such ones only is null). A row's scores are gathered once and sorted once;
    every draw is a list of how often each detector counts, and its median is where
    those numbers, added up in the order of the scores, pass the middle.
    """
    drawn = draws.groupBy("draw", "detector_id").agg(F.count(F.lit(1)).alias("times")).collect()  # as many as settings name
    names, numbers = sorted({r["draw"] for r in drawn}), {d: i for i, d in enumerate(sorted({r["detector_id"] for r in drawn}))}
    times = np.zeros((len(names), len(numbers)), np.int64)
    for r in drawn:
        times[names.index(r["draw"]), numbers[r["detector_id"]]] = r["times"]
    listed = z_scores.sparkSession.createDataFrame(list(numbers.items()), T.StructType([z_scores.schema["detector_id"], T.StructField("at", T.IntegerType())]))
    placed = z_scores.select(*rows, "detector_id", "z").join(F.broadcast(listed), "detector_id")
    held = placed.groupBy(*rows).agg(F.collect_list("at").alias("at"), F.collect_list("z").alias("z"))
    schema = T.StructType([*[held.schema[c] for c in rows], draws.schema["draw"], T.StructField("score", T.DoubleType())])
    kind = {"int": pa.int32(), "bigint": pa.int64()}.get(draws.schema["draw"].dataType.simpleString())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lengths = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
            z = np.full((n, len(numbers)), np.nan)
            z[np.repeat(np.arange(n), lengths), batch.column("at").flatten().to_numpy(zero_copy_only=False)] = (
                batch.column("z").flatten().to_numpy(zero_copy_only=False)
            )
            scores = np.stack([drawn_scores(own, how) for own in _in_order(z, times)], axis=1) if n else np.zeros((0, len(names)))
            again = pa.array(np.repeat(np.arange(n), len(names)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(again) for c in rows], pa.array(np.tile(names, n), kind), pa.array(scores.ravel(), from_pandas=True)],
                names=[*rows, "draw", "score"],
            )

    return held.mapInArrow(merged, schema)


def _in_order(z: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores of every row in order, and for each draw how often each counts; missing ones are last and don't count."""
    order = np.argsort(z, axis=1)
    ordered = np.take_along_axis(z, order, axis=1)
    there = ~np.isnan(ordered)
    for own in times:
        yield ordered, own[order] * there


def drawn_scores(own: tuple[np.ndarray, np.ndarray], how: str) -> np.ndarray:
    """A draw's score of every row."""
    ordered, times = own
    total = times.sum(axis=1)
    rows = np.arange(len(ordered))
    if how == "average":
        merged = np.where(times > 0, ordered, 0) * times
        return np.where(total > 0, merged.sum(axis=1) / np.maximum(total, 1), np.nan)
    if how == "maximisation":
        return np.where(total > 0, np.where(times > 0, ordered, -np.inf).max(axis=1), np.nan)
    passed = np.cumsum(times, axis=1)
    low, high = (np.argmax(passed > middle[:, None], axis=1) for middle in ((total - 1) // 2, total // 2))
    return np.where(total > 0, (ordered[rows, low] + ordered[rows, high]) / 2, np.nan)


def threshold(
    train_scores: DataFrame, keys: list[str], contamination: float = 0.1, ranges: int | None = None
) -> DataFrame:
    """Score above which the ``contamination`` share of the training rows lies."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    return quantile(train_scores, keys, "score", 1 - contamination, "threshold", ranges)


def detector_thresholds(
    train_scores: DataFrame, specs: list[DetectorSpec], keys: list[str], ranges: int | None = None
) -> DataFrame:
    """Threshold of every detector of a grid, at the contamination of its settings."""
    parts = []
    for share in sorted({s.contamination for s in specs}):
        ids = [s.detector_id for s in specs if s.contamination == share]
        of_share = train_scores.where(F.col("detector_id").isin(ids))
        parts.append(threshold(of_share, [*keys, "detector_id"], share, ranges))
    return reduce(DataFrame.unionByName, parts)


def predict(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """``label`` = 1 where the score exceeds the training threshold."""
    joined = attach(scores, small_side(thresholds), keys)
    return joined.withColumn("label", (F.col("score") > F.col("threshold")).cast("int"))


def decide(
    scores: DataFrame,
    keys: list[str],
    how: str = "median",
    contamination: float = 0.1,
    carry: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """An ensemble's ``score`` and ``label`` for every row: ``(*keys, split, doc_id, *carry, score, threshold, label)``.

    ``scores(*keys, split, doc_id, *carry, detector_id, score)`` are those of all members. They are standardised by
    their training moments and combined; a row is an outlier where the combined score exceeds the one above which the
    ``contamination`` share of the training rows lies. Keys without training rows get null scores and labels.
    """
    scores = settle(scores)
    scaler = fit_score_scaler(scores.where(F.col("split") == "train"), keys)
    joined = attach(scores, small_side(scaler), [*keys, "detector_id"], "left")
    spread = F.when(F.col("sigma") == 0, 1.0).otherwise(F.col("sigma"))
    scaled = joined.withColumn("z", (F.col("score") - F.col("mu")) / spread)
    combined = settle(combine(scaled, [*keys, "split", "doc_id", *(carry or [])], how))
    limits = threshold(combined.where(F.col("split") == "train"), keys, contamination, ranges)
    joined = attach(combined, small_side(limits), keys, "left")
    return joined.withColumn("label", (F.col("score") > F.col("threshold")).cast("int"))


def fit_proba(train_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Training range and moments used to turn scores into probabilities."""
    return train_scores.groupBy(*keys).agg(
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.avg("score").alias("mu"),
        F.stddev_pop("score").alias("sigma"),
    )


ERF_TERMS = 140  # enough for every |x| below 6, beyond which the function is 1 in doubles


@F.pandas_udf(T.DoubleType())
def erf(values: pd.Series) -> pd.Series:
    """The error function by its series of positive terms, a whole batch at a time."""
    x = np.minimum(np.abs(values.to_numpy(np.float64, na_value=np.nan)), 6.0)
    term = total = x.copy()
    for n in range(1, ERF_TERMS):
        term = term * (2 * x * x / (2 * n + 1))
        total = total + term
    return pd.Series(np.copysign(2 / math.sqrt(math.pi) * np.exp(-x * x) * total, values.to_numpy(np.float64, na_value=np.nan)))


def predict_proba(scores: DataFrame, fitted: DataFrame, keys: list[str], how: str = "linear") -> DataFrame:
    """Outlier probability: training min-max (``linear``) or the error function (``unify``)."""
    if how not in ("linear", "unify"):
        raise ValueError("how should be linear or unify")
    joined = attach(scores, small_side(fitted), keys)
    if how == "linear":
        raw = (F.col("score") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    else:
        raw = erf((F.col("score") - F.col("mu")) / F.nullif(F.col("sigma") * math.sqrt(2), F.lit(0.0)))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return joined.withColumn("proba", F.when(raw.isNotNull(), clipped)).drop("low", "high", "mu", "sigma")
