"""Session set-up and the size-checked helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size stays below this bound.
MAX_BROADCAST_BYTES = 128 << 20


def get_session(app: str = "textanomaly", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators are planned for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="textanomaly-checkpoint-")
    context.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    stored = df.checkpoint(eager=True)
    # fresh column identities, so the result can be joined with what it came from
    return stored.select(*[F.col(f"`{c}`").alias(c) for c in stored.columns])


def stored_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as compressed Parquet next to the checkpoints, and its folder, to be deleted by ``dropped``."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored rows whose readers have all been stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each job inside deletes its shuffle files at its end: what it made is stored, and not read from them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs inside hand at most so many rows at a time to Python; Spark's buffers for whole texts stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def widen(scan: DataFrame) -> DataFrame:
    """Spread the rows of a plain scan that has fewer splits than there are cores.

    Costly row-wise work on a corpus kept in few files would otherwise run in few
    tasks; a corpus of many splits is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        each = inner.jsonValue() if isinstance(inner, T.NumericType) else None
        if each is None:
            return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Rows' summed width, computed by Spark."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    total = widths[0].cast("long")
    for width in widths[1:]:
        total = total + width
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("bytes")).first()["bytes"]


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast when the measured size allows it; else leave a shuffle join.

    Beyond the bound the plain frame is returned and adaptive execution splits
    skewed partitions of the other side.
    """
    bound = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    return F.broadcast(df) if measured_bytes(df) <= bound else df


def small_side(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Compute a summary table once, then broadcast it if it proves small."""
    return broadcast_if_small(settle(df), max_bytes)


def attach(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Add the columns of a one-row-per-key table; null keys match each other."""
    extra = [c for c in side.columns if c not in keys]
    if not keys:
        return df.withColumns({c: side.select(c).scalar() for c in extra})
    renamed = side.select(*[F.col(k).alias(f"__{k}") for k in keys], *extra)
    condition = None
    for key in keys:
        test = df[key].eqNullSafe(renamed[f"__{key}"])
        condition = test if condition is None else condition & test
    return df.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
