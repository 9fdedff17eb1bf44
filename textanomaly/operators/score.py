"""Reconstruction scores from a model table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.detectors import net
from textanomaly.detectors.spec import DetectorSpec
from textanomaly.operators.fit import rows_of
from textanomaly.operators.neighbours import batch_counts, hash_batches
from textanomaly.session import attach, broadcast_if_small, measured_bytes, settle, small_side

# Every Python worker keeps its own copy of broadcast models.
MAX_MODEL_BYTES = 128 << 20
# Beyond that a task holds so many rows, in whole batches, and so many bytes of models at a time.
BLOCK_ROWS = 1 << 15
CHUNK_BYTES = 64 << 20


def rebuilt(rows: pd.DataFrame) -> list[tuple[DetectorSpec, dict]]:
    """Models from the rows of one key."""
    out = []
    for _, group in rows.groupby("detector_id"):
        params = {
            name: np.asarray(data, np.float32).reshape([int(s) for s in shape])
            for name, shape, data in zip(group["name"], group["shape"], group["data"])
        }
        out.append((DetectorSpec.from_json(group["spec"].iloc[0]), params))
    return out


def by_row(spec: DetectorSpec) -> bool:
    """Whether a row's score depends on that row alone."""
    return spec.family != "lne" and (spec.family != "rsr" or spec.score_mode == "eval")


def score(
    df: DataFrame,
    models: DataFrame,
    keys: list[str],
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    vector: str = "embedding",
    batch_size: int | None = None,
    within: list[str] | None = None,
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """``(*keys, doc_id, *carry, detector_id, score)`` for every row and model of its key.

    The score is the Euclidean distance between a row and its reconstruction.
    Models measured below ``max_model_bytes`` are broadcast: row-wise detectors
    then score where rows are read, and only those looking at neighbours gather
    hash batches (within ``keys`` and ``within``) of their own ``batch_size``, or of
    the one given here. Larger model tables are cogrouped with blocks of
    batches of their key. Rows of a key without any model are an error.
    """
    carry, within = carry or [], within or []
    columns = [*keys, "doc_id", *[c for c in carry if c not in keys]]
    rows = df.withColumnRenamed(id_col, "doc_id").select(*columns, F.col(vector).alias("embedding"))
    schema = T.StructType(
        [
            *[rows.schema[c] for c in columns],
            T.StructField("detector_id", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    names = [f.name for f in schema.fields]

    def scored(pdf: pd.DataFrame, detectors, *label) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy())
        parts = [
            pdf[columns].assign(detector_id=spec.detector_id, score=net.scores(spec, params, x, *label))
            for spec, params in detectors
        ]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    models = settle(models)  # measured and read: training should not run twice
    if models.isEmpty():
        raise ValueError("the model table is empty: fit detectors first")
    check_fitted(rows, models, keys)
    size_of = F.lit(batch_size) if batch_size else F.get_json_object("spec", "$.batch_size").cast("int")
    if measured_bytes(models) <= max_model_bytes:
        table = models.toPandas()
        held = {tuple(k): rebuilt(g) for k, g in table.groupby(keys)} if keys else {(): rebuilt(table)}
        every = [spec for group in held.values() for spec, _ in group]
        shared = df.sparkSession.sparkContext.broadcast(held)

        def of_key(key, wanted):
            return [m for m in shared.value.get(tuple(key), []) if by_row(m[0]) == wanted]

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                groups = [((), batch)]
                if keys:
                    places = batch.select(keys).to_pandas().groupby(keys, dropna=False).indices
                    groups = [(k if isinstance(k, tuple) else (k,), batch.take(i)) for k, i in places.items()]
                for key, part in groups:
                    for spec, params in of_key(key, True) if part.num_rows else []:
                        found = net.scores(spec, params, rows_of(part.column("embedding")), *key)
                        added = [pa.array([spec.detector_id] * len(found), pa.string()), pa.array(found)]
                        yield pa.RecordBatch.from_arrays([*part.select(columns).columns, *added], names=names)

        def in_batch(size: int):
            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("doc_id")
                key = [pdf[k].iloc[0] for k in keys]
                found = [m for m in of_key(key, False) if (batch_size or m[0].batch_size) == size]
                return scored(pdf, found, *key, *[pdf[c].iloc[0] for c in within], pdf["batch"].iloc[0])

            return run

        results = []
        if any(by_row(s) for s in every):
            results.append(rows.mapInArrow(in_place, schema))
        for size in sorted({batch_size or s.batch_size for s in every if not by_row(s)}):
            batched = hash_batches(rows, [*keys, *within], size)
            results.append(batched.groupBy(*keys, *within, "batch").applyInPandas(in_batch(size), schema))
        return reduce(DataFrame.unionByName, results)

    sized = models.withColumn("__size", size_of)
    sizes = sorted(r[0] for r in sized.select("__size").distinct().collect())  # as many as settings name
    scored_in_batches = [
        by_cogroup(rows, sized.where(F.col("__size") == size).drop("__size"), keys, within, size, scored, schema)
        for size in sizes
    ]
    return reduce(DataFrame.unionByName, scored_in_batches)


def check_fitted(rows: DataFrame, models: DataFrame, keys: list[str]) -> None:
    """Raise for keys of ``rows`` that no model was fitted for."""
    if not keys:
        return
    fitted = models.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    missing = rows.select(*keys).distinct().join(fitted, same, "left_anti").take(5)
    if missing:
        raise ValueError(f"not fitted for {[tuple(r) for r in missing]}")


def by_cogroup(rows, models, keys, within, batch_size, scored, schema) -> DataFrame:
    """Scores from blocks of batches cogrouped with the models of their key.

    A block is many batches and a chunk of models is bounded in bytes, so a task holds one of each; models are
    copied once a block of rows, and rows once a chunk of their key's models.
    """
    names = [f.name for f in schema.fields]
    group = [*keys, *within]
    per_block = max(1, BLOCK_ROWS // batch_size)
    counts = small_side(batch_counts(rows, group, batch_size))
    batched = hash_batches(rows, group, batch_size, counts=counts)
    batched = batched.withColumn("block", F.floor(F.col("batch") / per_block))

    sizes = models.groupBy(*keys, "detector_id").agg(F.sum(F.size("data") * 4).alias("bytes"))
    before = Window.partitionBy(*keys).orderBy("detector_id").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / CHUNK_BYTES)
    placed = settle(sizes.select(*keys, "detector_id", chunk.alias("chunk")))
    chunks = small_side(placed.groupBy(*keys).agg(F.collect_set("chunk").alias("chunks")))
    batched = attach(batched, chunks, keys).withColumn("chunk", F.explode("chunks")).drop("chunks")

    numbered = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("batches") / per_block) - 1))
    if keys:
        copies = models.join(counts, keys).withColumn("block", numbered).drop("batches")
    else:
        plan = counts.agg(F.collect_list(F.struct(*within, "batches"))).scalar()
        copies = models.withColumn("plan", F.explode(plan)).select(*models.columns, "plan.*")
        copies = copies.withColumn("block", numbered).drop("batches")
    copies = attach(copies, broadcast_if_small(placed), [*keys, "detector_id"])

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        detectors = rebuilt(right)
        label = [left[c].iloc[0] for c in group]
        parts = [
            scored(part.sort_values("doc_id"), detectors, *label, number) for number, part in left.groupby("batch")
        ]
        return pd.concat(parts)

    place = [*group, "block", "chunk"]
    return batched.groupBy(*place).cogroup(copies.groupBy(*place)).applyInPandas(pair, schema)
