"""Helpers the operators share: stored tables, word columns, batches of words as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.session import ensure_checkpoint_dir, settle

WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# a task works on so many bytes of text at a time, or on one longer text
PIECE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def shared_path(df: DataFrame, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, lineage cut."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A new shared folder of intermediate tables, each deleted once what was made of it is stored."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, shared_path(df, name)

    def store(self, df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None, options: dict | None = None) -> DataFrame:
        df.write.options(compression=codec, **(options or {})).parquet(f"{self.path}/{name}", partitionBy=by)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables whose readers have all been stored."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the given order, each range of rows numbered apart."""
    ordered = settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # one row a partition, so this window stays small whatever the input
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    joined = ordered.withColumn("__row", within).join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__p", "__before", "__row", "__n")


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by bytes, so that a task's arrays stay small."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0)
        start, total = 0, 0
        for i, size in enumerate(sizes.to_pylist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [value or b"" for value in values.cast(pa.binary()).to_pylist()]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    if count:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES + (1 << 18), 1 << count.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWERS[size]


class Words:
    """The words of several texts: where they start and end, their text's number and their 64-bit hash."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        blob = b"\n" + b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(blob, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        space = IS_SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, int)
        # words [first[i], first[i + 1]) belong to text i
        self.first = np.append(np.searchsorted(self.starts, self.text_starts), len(self.starts))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """Polynomial hashes of all words from one running sum, then mixed."""
        power, inverse = _tables(len(self.data))
        terms = (self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

