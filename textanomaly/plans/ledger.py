"""Scores of a grid kept by cell, so that a stopped grid goes on where it ended.

A cell is one detector on one (run, inlier). Cells are fitted in blocks; a block's scores are written first, and its
cells are entered in the ledger after that. Both writes replace the block's own partition, so repeating one changes
nothing, and scores without an entry are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.detectors.spec import DetectorSpec
from textanomaly.operators.fit import detectors_per_task, fit_and_score
from textanomaly.session import broadcast_if_small, settle
from textanomaly.sources.corpus import exists, write_partitions

GROUP = ["run", "inlier"]
CELL = [*GROUP, "detector_id", "spec"]
COMMIT_CELLS = 4096  # a stopped grid repeats so many cells at most (or one group's, if it has more)


def weights_digest(start: dict[str, dict] | None) -> str:
    """A name for given starting weights."""
    found = hashlib.sha256()
    for detector in sorted(start or {}):
        for name in sorted(start[detector]):
            value = np.asarray(start[detector][name])
            found.update(f"{detector}|{name}|{value.dtype}|{value.shape}|".encode() + value.tobytes())
    return found.hexdigest()


def cells(groups: DataFrame, specs: list[DetectorSpec]) -> DataFrame:
    """(run, inlier, detector_id, spec) of every detector on every group."""
    listed = F.array(*[F.struct(F.lit(s.detector_id).alias("detector_id"), F.lit(s.to_json()).alias("spec")) for s in specs])
    return groups.select(*GROUP, F.explode(listed).alias("s")).select(*GROUP, "s.detector_id", "s.spec")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def entries(wanted: DataFrame, path: str) -> DataFrame:
    """The finished cells among ``wanted`` with the block that holds them, each once."""
    schema = T.StructType([*[wanted.schema[c] for c in CELL], T.StructField("block", T.StringType())])
    found = _stored(wanted.sparkSession, f"{path}/ledger", schema)
    # two runs at a time may both have fitted a cell
    once = found.groupBy(*CELL).agg(F.min("block").alias("block"))
    return once.join(broadcast_if_small(wanted), CELL, "left_semi")


def fill(
    rows: Callable[[], DataFrame],
    wanted: DataFrame,
    specs: list[DetectorSpec],
    path: str,
    carry: list[str],
    commit_cells: int = COMMIT_CELLS,
    commits: int | None = None,
    tasks: int | None = None,
    **fit_options,
) -> int:
    """Fit and score the cells that the ledger lacks, a block of whole groups a commit; returns how many were fitted.

    ``rows`` gives the split rows, and is only asked if a cell is missing. ``commits`` stops after so many blocks.
    """
    spark = wanted.sparkSession
    todo = settle(wanted.join(entries(wanted, path).drop("block"), CELL, "left_anti"))
    missing = todo.count()
    if not missing:
        return 0
    blocks = -(-missing // commit_cells)
    todo = todo.withColumn("__part", F.pmod(F.xxhash64(*GROUP), F.lit(blocks)))
    # named after their cells, so a block that is written again takes its own place
    name = F.concat_ws("-", F.count(F.lit(1)).cast("string"), F.hex(F.bit_xor(F.xxhash64(*CELL))))
    sizes = todo.groupBy("__part").agg(
        name.alias("block"), F.count(F.lit(1)).alias("cells"), F.count_distinct(*GROUP).alias("groups")
    )
    split, fitted = settle(rows()), 0
    for block in sizes.orderBy("__part").limit(commits or blocks).collect():  # one row a commit
        own = todo.where(F.col("__part") == block["__part"]).drop("__part")
        of_block = split.join(F.broadcast(own.select(*GROUP).distinct()), GROUP, "left_semi")  # at most commit_cells
        per_task = detectors_per_task(len(specs), block["groups"], spark.sparkContext.defaultParallelism)
        scores = fit_and_score(
            of_block, specs, GROUP, carry, per_task=per_task, tasks=tasks, wanted=own.select(*GROUP, "detector_id"), **fit_options
        )
        write_partitions(scores.withColumn("block", F.lit(block["block"])), f"{path}/scores", "block")
        write_partitions(own.withColumn("block", F.lit(block["block"])), f"{path}/ledger", "block")
        fitted += block["cells"]
    return fitted


def scores(wanted: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Scores of the finished cells among ``wanted``."""
    held = _stored(wanted.sparkSession, f"{path}/scores", T.StructType([*schema.fields, T.StructField("block", T.StringType())]))
    keys = [*GROUP, "detector_id", "block"]
    return held.join(broadcast_if_small(entries(wanted, path).select(*keys)), keys, "left_semi").drop("block")
