"""Quality classifier: random-indexing word vectors pooled by document, and a two-layer network with a temperature.

Every word and its shape (kinds of characters, or that it repeats the word before it) is a token in a fixed number of
buckets. A bucket has a sparse random index vector; its word vector is the sum of the index vectors that stand next to
its tokens anywhere in the corpus. Tasks add these up in whole numbers, and the sums of tasks are added in two
steps, so the table that reaches the driver has a fixed size. A document is the mean of its tokens' vectors, words and
shapes apart, and the logarithm of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import Words, mixed, pieces, stored, text_bytes
from textanomaly.session import broadcast_if_small

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 14, 1 << 9
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
DIM, NONZERO = 64, 4
WINDOW = 2  # tokens to either side
SLICE = 256  # buckets a row when tasks' sums are added
TRAIN_ROWS = 20_000  # the network is fitted on at most so many labelled rows, taken in the order of a hash
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.003, 1e-4
THRESHOLD = 0.3
SEED = 11

# one bit a kind of character; the symbols have one each
KIND = np.zeros(256, np.uint32)
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 4
for _bit, _symbol in enumerate(b"!#$%&*|<>@=/\\_~^"):
    KIND[_symbol] = 8 << _bit
_REPEATED = np.uint32(1 << 31)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero numbers of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and shapes in turn, and where each text's begin."""
    words = Words(texts, lower=False)
    if not len(words):
        return np.zeros(0, np.int64), 2 * words.first
    hashes = words.hashes()
    edges = np.column_stack([words.starts, words.ends]).ravel()
    shape = np.bitwise_or.reduceat(KIND[words.data], edges)[::2]
    again = np.append(False, hashes[1:] == hashes[:-1])
    again[words.first[:-1][words.first[:-1] < len(words)]] = False
    shape = np.where(again, _REPEATED, shape)
    found = np.empty(2 * len(words), np.int64)
    found[::2] = hashes % np.uint64(WORD_BUCKETS)
    found[1::2] = WORD_BUCKETS + (mixed(shape.astype(np.uint64)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
    return found, 2 * words.first


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = _index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in pieces(batches):
        found, first = tokens(text_bytes(batch))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(text[step:] == text[:-step])
            for one, other in ((found[near], found[near + step]), (found[near + step], found[near])):
                for k in range(NONZERO):
                    total += np.bincount(one * DIM + place[other, k], sign[other, k], BUCKETS * DIM)
    rows = np.rint(total).astype(np.int64).reshape(-1, SLICE * DIM)
    task = TaskContext.get().partitionId()
    yield _sum_rows(range(len(rows)), [task] * len(rows), rows)


def _sum_rows(slices, tasks, rows) -> pa.RecordBatch:
    kept = [i for i, r in enumerate(rows) if r.any()]
    data = [zlib.compress(rows[i].tobytes(), 1) for i in kept]
    arrays = [
        pa.array([slices[i] for i in kept], pa.int32()), pa.array([tasks[i] for i in kept], pa.int32()), pa.array(data, pa.binary())
    ]
    return pa.RecordBatch.from_arrays(arrays, ["slice", "task", "sums"])


def _added(key, table):
    total = np.zeros(SLICE * DIM, np.int64)
    for data in table["sums"]:
        total += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
    return pa.Table.from_batches([_sum_rows([key[0].as_py()], [key[1].as_py()], [total])])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector of length 1 a bucket (zeros for buckets that no text has), from all texts."""
    kind = "slice int, task int, sums binary"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sums = texts.mapInArrow(_task_sums, kind)
    fan = max(2, int(texts.rdd.getNumPartitions() ** 0.5))
    for step in (F.floor(F.col("task") / fan), F.lit(0)):
        sums = sums.withColumn("task", step.cast("int")).groupBy("slice", "task").applyInArrow(_added, kind)
    vectors = np.zeros((BUCKETS // SLICE, SLICE * DIM))
    for row in sums.collect():  # at most BUCKETS x DIM numbers
        vectors[row["slice"]] = np.frombuffer(zlib.decompress(row["sums"]), np.int64)
    vectors = vectors.reshape(BUCKETS, DIM)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word and shape vectors and the logarithm of the number of words, a row a text."""
    found, first = tokens(texts)
    result = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    counts = np.diff(first) // 2
    result[:, -1] = np.log1p(counts)
    # bounded slices of tokens; a text's sum may come from several
    for start in range(0, len(found), 1 << 18):
        part = found[start : start + (1 << 18)]
        inner = np.clip(first, start, start + len(part)) - start
        filled = np.flatnonzero(np.diff(inner) > 0)
        for offset, at in ((0, slice(0, DIM)), (1, slice(DIM, 2 * DIM))):
            sums = np.add.reduceat(vectors[part[offset::2]], inner[:-1][filled] // 2, axis=0)
            result[filled, at] += sums
    result[:, :-1] /= np.maximum(counts, 1)[:, None]
    return result


class Network:
    """Two layers on standardised inputs; the logit is divided by the temperature."""

    def __init__(self, mean, scale, weights, temperature):
        self.mean, self.scale, self.weights, self.temperature = mean, scale, weights, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -500, 500)))


class Constant:
    """Without labels of both kinds: the share of good ones, one half without any."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network | Constant:
    """Fit on the rows not set ``aside``; the temperature minimises the loss of those that are."""
    if len(np.unique(y)) < 2 or len(np.unique(y[~aside])) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    fitted, wanted = x[~aside], y[~aside]
    mean, scale = fitted.mean(axis=0), fitted.std(axis=0) + 1e-6
    z = (fitted - mean) / scale
    weights = [
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())
    ]
    first, second, turn = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - wanted[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            turn += 1
            for i, slope in enumerate(slopes):
                slope = slope + DECAY * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                step = first[i] / (1 - 0.9**turn) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
                weights[i] = weights[i] - RATE * step
    network = Network(mean, scale, weights, 1.0)
    if aside.any():
        logits = network.logits(x[aside])
        network.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[aside])))
    return network


def fold(doc_id: Column, count: int) -> Column:
    """crc32 of the id as text, modulo ``count``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % count).cast("int")


def _pooler(vectors):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = pooled(text_bytes(batch), vectors.value)
            arrays = [batch.column(1), batch.column(2), pa.array(list(rows), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["quality", "part", "x"])

    return pool


def fit(docs: DataFrame, labels: DataFrame, row_limit: int = TRAIN_ROWS):
    """(word vectors, network) from all texts and from labelled rows whose crc32 modulo 5 isn't 0.

    Those with remainder 1 are set aside for the temperature. Labels of a doc_id that disagree are averaged, and one
    half counts as good; labels that are null or of unknown documents aren't used.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
    marks = marks.agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    marks = marks.withColumn("part", fold(F.col("doc_id"), 5)).where("part <> 0")
    known = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(row_limit), "quality-sample")
    sample = broadcast_if_small(sample.withColumnRenamed("doc_id", "__id"))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, F.col("doc_id") == F.col("__id"))
    shared = spark.sparkContext.broadcast(vectors)
    chosen = chosen.dropDuplicates(["doc_id"]).select("text", "quality", "part")
    table = chosen.mapInArrow(_pooler(shared), "quality double, part int, x array<float>").toArrow()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, 2 * DIM + 1)
    y, part = np.asarray(table["quality"], np.float64), np.asarray(table["part"])
    order = np.lexsort([*x.T[:4], y])  # the same order whatever the partitions
    return vectors, fit_network(x[order], y[order], part[order] == 1)


def _scorer(model, column: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for batch in pieces(batches):
            scores = network.scores(pooled(text_bytes(batch), vectors).astype(np.float64))
            arrays = [*batch.columns, pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__score"])

    return score


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score (of good quality) and predicted (1 from ``THRESHOLD`` on).

    Scores come from the text alone; null and empty texts have the score of no words. Equal texts have equal scores.
    Columns with these names are replaced. Without labels of both kinds every score is the share of good ones.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.drop("held_out", "score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(_scorer(model, rows.columns.index("text")), f"{schema}, `__score` double")
    scored = scored.withColumnRenamed("__score", "score").withColumns(
        {"held_out": fold(F.col("doc_id"), 5) == 0, "predicted": (F.col("score") >= THRESHOLD).cast("int")}
    )
    return scored if keep_text else scored.drop("text")
