"""Fitting detectors: many small groups in parallel, or one large table by all tasks.

A model table has one row a parameter: ``(*keys, detector_id, spec, name, shape, data)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.detectors import net
from textanomaly.detectors.spec import DetectorSpec
from textanomaly.functions.hashing import leading_bits, order_key
from textanomaly.operators.neighbours import batch_counts, hash_batches
from textanomaly.operators.scale import fit_scaler
from textanomaly.session import attach, settle, small_side

# A group up to this many rows is trained inside one task, a larger one by all tasks; both take the same batches
# in the same steps, so this only says where a group is trained.
MAX_GROUP_ROWS = 5000
# Models of large groups that are trained in the same jobs; more are trained in waves.
MAX_DRIVER_BYTES = 1 << 30
# Bytes of vectors that one task of a large fit reads a step, partitions that steps are spread over up to there, and
# (group, chunk) pieces a core in a grid.
TASK_BYTES, STEP_PARTS = 16 << 20, 128
PIECES = 32


PACKED = T.StructType(
    [
        T.StructField("lane", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def model_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("detector_id", T.StringType()),
            T.StructField("spec", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("data", T.ArrayType(T.FloatType())),
        ]
    )


def model_rows(spec: DetectorSpec, params: dict) -> list[tuple]:
    """Rows of one model; masks are not needed once training is over."""
    return [
        (spec.detector_id, spec.to_json(), name, list(value.shape), value.astype(np.float32).ravel())
        for name, value in params.items()
        if not name.endswith(".mask")
    ]


def chunked(specs: list[DetectorSpec], per_task: int) -> list[list[DetectorSpec]]:
    ids = [s.detector_id for s in specs]
    if not specs or len(set(ids)) != len(ids):
        raise ValueError("detector ids must be given and differ")
    count = -(-len(specs) // per_task)
    return [specs[i::count] for i in range(count)]


def detectors_per_task(detectors: int, groups: int, cores: int) -> int:
    """How many detectors a task takes: rows are copied once a chunk, so no more chunks than cores need."""
    chunks = min(detectors, -(-PIECES * cores // max(groups, 1)))
    return -(-detectors // chunks)


def spread(df: DataFrame, keys: list[str], chunks: int, tasks: int | None, wanted: DataFrame | None = None) -> DataFrame:
    """Copy rows once a chunk of detectors (one that ``wanted`` has), and give each (key, chunk) its own place.

    The explicit partition number keeps adaptive execution from merging groups
    that are small in bytes but costly to train.
    """
    copies = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    if wanted is not None:
        copies = attach(copies, wanted, [*keys, "chunk"])
    if tasks is None:
        spark = df.sparkSession
        tasks = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return copies.repartition(tasks, *keys, "chunk")


def split_by_size(df: DataFrame, keys: list[str], max_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Groups small enough for one task, and the others (None if there are none)."""
    if max_rows is None:
        return df, None
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_rows).drop("__n")
    large = large.withColumn("__large", F.lit(True))
    if not keys:
        return (df, None) if df.count() <= max_rows else (df.limit(0), df)
    large = settle(large)
    if large.isEmpty():
        return df, None
    marked = attach(df, small_side(large), keys, "left")
    small = marked.where(F.col("__large").isNull()).drop("__large")
    return small, marked.where(F.col("__large")).drop("__large")


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add what the batches of a row follow from, and the group's name in seeds."""
    spread = leading_bits(order_key(0, "batch", F.col("doc_id")))
    return df.withColumns({"__spread": spread, "__model": model_name(keys)})


def model_name(keys: list[str]):
    return F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")


def batch_numbers(rows: pd.DataFrame, spec: DetectorSpec) -> np.ndarray:
    """The hash batch of every row of a group, as ``hash_batches`` gives it."""
    return (rows["__spread"] % max(1, -(-len(rows) // spec.batch_size))).to_numpy()


def fit_detectors(
    train: DataFrame,
    specs: list[DetectorSpec],
    keys: list[str],
    id_col: str = "doc_id",
    vector: str = "embedding",
    per_task: int = 8,
    tasks: int | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    start: dict[str, dict] | None = None,
) -> DataFrame:
    """Fit every detector on every group; returns the model table.

    Groups from contaminated splits are bounded by their split size and trained
    inside a task. A group above ``max_group_rows`` is trained by all tasks
    together (``fit_detector_large``); None skips the count where groups are
    known to be small. ``start`` has weights by detector that training begins at,
    by parameter name; other detectors begin at seeded ones.
    """
    start = start or {}
    chunks = chunked(specs, per_task)
    rows = train.select(*keys, F.col(id_col).alias("doc_id"), F.col(vector).alias("embedding"))
    small, large = split_by_size(rows, keys, max_group_rows)
    schema = model_schema(rows, keys)

    def train_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        key = [pdf[k].iloc[0] for k in keys]
        x = np.stack(pdf["embedding"].to_numpy())
        out = []
        picked, name = chunks[pdf["chunk"].iloc[0]], pdf["__model"].iloc[0]
        for spec, params in net.fit_alike(picked, x, *key, batches=lambda spec: batch_numbers(pdf, spec), name=name, start=start):
            out += [(*key, *row) for row in model_rows(spec, params)]
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    models = spread(_numbered(small, keys), keys, len(chunks), tasks).groupBy(*keys, "chunk").applyInPandas(train_group, schema)
    return models if large is None else models.unionByName(fit_detectors_large(large, specs, keys, start=start))


def fit_and_score(
    rows: DataFrame,
    specs: list[DetectorSpec],
    keys: list[str],
    carry: list[str] | None = None,
    per_task: int = 8,
    tasks: int | None = None,
    train: str = "train",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    start: dict[str, dict] | None = None,
    wanted: DataFrame | None = None,
    scored: str | None = None,
) -> DataFrame:
    """Fit on the train rows of a group and score all its rows in the same task.

    ``rows(*keys, split, doc_id, embedding)``; returns long scores ``(*keys, split,
    doc_id, *carry, detector_id, score)``. Parameters never leave the task, so
    grids of many detectors shuffle vectors once and nothing else. Groups above
    ``max_group_rows`` are fitted by all tasks and scored from their model table.
    ``start`` is as in ``fit_detectors``. ``wanted(*keys, detector_id)`` names the
    detectors to fit on each group, if not all on all. ``scored`` is the only split whose
    scores are wanted, if not all are.
    """
    from textanomaly.operators.score import score

    start = start or {}
    chunks = chunked(specs, per_task)
    carry = carry or []
    columns = [*keys, "split", "doc_id", *carry]
    rows = rows.select(*columns, "embedding")
    schema = T.StructType(
        [
            *[rows.schema[c] for c in columns],
            T.StructField("detector_id", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    chosen = wanted is not None

    def run_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["split", "doc_id"]).reset_index(drop=True)
        key = [pdf[k].iloc[0] for k in keys]
        learn = pdf[pdf["split"] == train]
        picked = chunks[pdf["chunk"].iloc[0]] if len(learn) else []
        if chosen:
            picked = [s for s in picked if s.detector_id in set(pdf["__wanted"].iloc[0])]
        if not picked:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        vectors, name = np.stack(pdf["embedding"].to_numpy()), learn["__model"].iloc[0]
        x = vectors[learn.index]
        cut: dict[int, list] = {}

        def pieces(size: int) -> list[tuple]:
            """Without batches in the key, rows of a split are scored in equal slices of the hash order."""
            if size not in cut:
                cut[size] = [
                    (split, number, np.asarray(index))
                    for split, part in pdf.groupby("split")
                    if scored in (None, split)
                    for number, index in part.groupby(part["__spread"] % -(-len(part) // size)).groups.items()
                ]
            return cut[size]

        places, found = [], []
        for spec, params in net.fit_alike(picked, x, *key, batches=lambda spec: batch_numbers(learn, spec), name=name, start=start):
            for split, number, at in pieces(spec.batch_size):
                found.append(net.scores(spec, params, vectors[at], *key, split, number))
                places.append(at)
        ids = np.repeat([s.detector_id for s in picked], [sum(len(at) for _, _, at in pieces(s.batch_size)) for s in picked])
        if not places:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        return pdf[columns].iloc[np.concatenate(places)].assign(detector_id=ids, score=np.concatenate(found))

    small, large = split_by_size(rows, keys, max_group_rows)
    lists = None if wanted is None else small_side(wanted_by_chunk(wanted, chunks, keys))
    copies = spread(_numbered(small, keys), keys, len(chunks), tasks, lists)
    scores = copies.groupBy(*keys, "chunk").applyInPandas(run_group, schema)
    if large is not None:
        learn = large.where(F.col("split") == train)
        models = fit_detectors_large(learn, specs, keys, start=start, wanted=wanted)
        if wanted is not None:
            large = large.join(F.broadcast(models.select(*keys).distinct()), keys, "left_semi")
        if scored is not None:
            large = large.where(F.col("split") == scored)
        found = score(large, models, keys, carry=["split", *carry], within=["split"])
        scores = scores.unionByName(found.select(*[f.name for f in schema.fields]))
    return scores


def wanted_by_chunk(wanted: DataFrame, chunks: list[list[DetectorSpec]], keys: list[str]) -> DataFrame:
    """The wanted detectors of every group, by chunk."""
    numbers = [(s.detector_id, i) for i, chunk in enumerate(chunks) for s in chunk]
    numbered = wanted.sparkSession.createDataFrame(numbers, "detector_id string, chunk int")
    listed = wanted.join(F.broadcast(numbered), "detector_id")  # as many as settings name
    return listed.groupBy(*keys, "chunk").agg(F.collect_set("detector_id").alias("__wanted"))


def fit_detector_large(
    df: DataFrame,
    spec: DetectorSpec,
    keys: list[str] | None = None,
    id_col: str = "doc_id",
    vector: str = "embedding",
    tasks: int | None = None,
    max_driver_bytes: int = MAX_DRIVER_BYTES,
    start: dict | None = None,
) -> DataFrame:
    """Fit one detector on tables of any size, one model a key, all tasks together (``fit_detectors_large``)."""
    starts = None if start is None else {spec.detector_id: start}
    return fit_detectors_large(df, [spec], keys, id_col, vector, tasks, max_driver_bytes, starts)


def fit_detectors_large(
    df: DataFrame,
    specs: list[DetectorSpec],
    keys: list[str] | None = None,
    id_col: str = "doc_id",
    vector: str = "embedding",
    tasks: int | None = None,
    max_driver_bytes: int = MAX_DRIVER_BYTES,
    start: dict[str, dict] | None = None,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Fit detectors on tables of any size, one model a key and detector, all tasks together.

    Rows are laid out once a batch size in hash batches of about that size (whole batches
    stay in a task, a hot key covers many tasks) and written to the checkpoint
    folder; where there are fewer batches than cores, detectors are dealt over lanes
    that each hold a copy. A step is a job without a shuffle, whatever the number and
    shapes of the detectors, on the partitions of its own batches only: each task adds up the
    gradients of its batches by key and detector, and only model-sized vectors reach the
    driver, which adds them up and moves the weights. As in ``net.fit`` a step takes
    ``batches_per_step`` batches of each group; they act as one synchronous batch,
    normalisation statistics stay local to a batch and the running ones are
    row-weighted means. Models above ``max_driver_bytes`` together are trained in
    waves, each from the same layout. ``start`` has the weights by detector that models
    begin at instead of seeded ones; ``wanted(*keys, detector_id)`` the models to fit, if
    not all.
    """
    keys = keys or []
    spark = df.sparkSession
    rows = df.select(*keys, F.col(id_col).alias("doc_id"), as_float(vector).alias("embedding"))
    scaler = settle(fit_scaler(rows, keys)) if any(s.standardize for s in specs) else None
    if wanted is not None:
        named = wanted.select(*keys, "detector_id").distinct().groupBy(*keys).agg(F.collect_set("detector_id").alias("__wanted"))
    lengths = rows.groupBy(*keys).agg(F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("low"))
    members = lengths.where(F.col("dim").isNotNull()).withColumn("model", model_name(keys))
    if scaler is not None:
        members = attach(members, scaler, keys)
    if wanted is not None:
        members = attach(members, small_side(named), keys)
    members = settle(members)
    if not members.where("low <> dim").isEmpty():
        raise ValueError("vectors of one group differ in length")
    table = spark.createDataFrame([], model_schema(df, keys))
    for size in sorted({s.batch_size for s in specs}):
        own = [s for s in specs if s.batch_size == size]
        laid_out, most, lanes = _layout(rows, keys, size, len(own), tasks, min(s.batches_per_step for s in own))
        # a step runs on the partitions of its own batches only; what is lost is read from the layout again
        batches = laid_out.rdd.persist(StorageLevel.MEMORY_AND_DISK)
        places: dict[int, set] = {}
        for number, place in laid_out.select("batch", F.spark_partition_id()).distinct().collect():  # one row a batch
            places.setdefault(number, set()).add(place)
        for pace in sorted({s.batches_per_step for s in own}):
            paced = [s for s in own if s.batches_per_step == pace]
            # beside weights, moments and sums, the driver holds those of the tasks that share a model's step
            sent = 1 + min(pace, 4 * spark.sparkContext.defaultParallelism) // 2
            for wave in _waves(members, paced, keys, start or {}, max_driver_bytes // sent, wanted is not None):
                table = table.unionByName(_trained(batches, places, wave, -(-most // pace), lanes, model_schema(df, keys)))
        batches.unpersist()
    return table


def _layout(rows: DataFrame, keys: list[str], batch_size: int, detectors: int, tasks: int | None, pace: int) -> tuple[DataFrame, int, int]:
    """Batches (lane, model, batch, rows, data), each whole in a task, the most batches of a model and the lanes.

    The batches of a step lie together in a few partitions of their own, as far as there are partitions.
    """
    spark = rows.sparkSession
    counts = small_side(batch_counts(rows, keys, batch_size))
    of_all, most = counts.agg(F.coalesce(F.sum("batches"), F.lit(0)), F.coalesce(F.max("batches"), F.lit(0))).first()
    lanes = min(detectors, -(-2 * spark.sparkContext.defaultParallelism // max(of_all, 1)))
    if tasks is None:
        first = rows.select(F.size("embedding")).first()
        held = lanes * of_all * batch_size * 4 * (first[0] if first else 0)
        tasks = min(lanes * max(of_all, 1), max(STEP_PARTS, -(-held // TASK_BYTES)))
    slots = 4 * spark.sparkContext.defaultParallelism
    laid_out = (
        hash_batches(rows, keys, batch_size, counts=counts)
        .withColumn("model", model_name(keys))
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        .withColumns({"step": F.floor(F.col("batch") / pace), "slot": F.pmod(F.xxhash64("model", "batch", "lane"), F.lit(slots))})
        .repartition(tasks, "step", "slot")
        .sortWithinPartitions("lane", "model", "batch", "doc_id")
    )
    return settle(packed(laid_out)), most, lanes


def _waves(members: DataFrame, specs: list[DetectorSpec], keys: list[str], start: dict, most_bytes: int, chosen: bool):
    """Starting parameters of (model, detector), as many at a time as the driver may hold."""
    wave, held = {}, 0
    for row in members.orderBy("model").toLocalIterator():
        key = tuple(row[k] for k in keys)
        for spec in specs:
            if chosen and spec.detector_id not in row["__wanted"]:
                continue
            seed = net.seeded(spec.seed, spec.detector_id, *key)
            params = net.starting(spec, row["dim"], seed, start.get(spec.detector_id))
            if spec.standardize:
                sigma = np.asarray(row["sigma"], np.float32)
                params["in.mu"], params["in.sigma"] = np.asarray(row["mu"], np.float32), np.where(sigma == 0, 1, sigma)
            size = 4 * sum(p.nbytes for p in params.values())
            if wave and held + size > most_bytes:
                yield wave
                wave, held = {}, 0
            wave[row["model"], spec.detector_id] = (spec, key, params)
            held += size
    if wave:
        yield wave


def _trained(batches: RDD, held: dict[int, set], wave: dict[tuple, tuple], steps: int, lanes: int, schema: T.StructType) -> DataFrame:
    """The model rows of one wave of (spec, key, starting parameters), written to the checkpoint folder."""
    optimizers = {name: net.Adam(spec.learning_rate, spec.weight_decay) for name, (spec, _, _) in wave.items()}
    pace = next(iter(wave.values()))[0].batches_per_step
    for turn in range(max(spec.epochs for spec, _, _ in wave.values()) * steps):
        epoch, step = divmod(turn, steps)
        numbers = range(step * pace, (step + 1) * pace)
        places = sorted(set().union(*[held.get(number, ()) for number in numbers]))
        if not places:
            continue
        models = {name: (spec, params) for name, (spec, _, params) in wave.items() if epoch < spec.epochs}
        for name, grads, stats in gradient_sums(batches, models, epoch, lanes, numbers, places):
            optimizers[name].step(models[name][1], grads)
            net.update_running(models[name][1], stats)
    data = [(*key, *row[:4], row[4].tolist()) for spec, key, params in wave.values() for row in model_rows(spec, params)]
    return settle(SparkSession.active().createDataFrame(data, schema))


def as_float(vector: str):
    return F.col(vector).cast("array<float>")


def rows_of(vectors: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def whole_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int, np.ndarray]]:
    """Rows arrive sorted by (lane, model, batch); yield each batch whole."""
    key, held = None, []
    for frame in frames:
        lanes, names, numbers = (frame.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = (names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1]) | (lanes[1:] != lanes[:-1])
        ends = [*(np.flatnonzero(new) + 1), len(names)] if len(names) else []
        start = 0
        for end in ends:
            found = (lanes[start], names[start], numbers[start])
            if held and key != found:
                yield *key, np.concatenate(held)
                held = []
            key = found
            held.append(rows_of(frame.column(3).slice(start, end - start)))
            start = end
    if held:
        yield *key, np.concatenate(held)


def packed(laid_out: DataFrame) -> DataFrame:
    """(lane, model, batch, rows, data: their float vectors' bytes) of every batch, in the partitions that hold them."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, name, number, x in whole_batches(frames):
            cells = [[lane], [name], [number], [len(x)], [np.ascontiguousarray(x, np.float32).tobytes()]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=PACKED.names)

    return laid_out.select("lane", "model", "batch", "embedding").mapInArrow(pack, PACKED)


def gradient_sums(
    batches: DataFrame | RDD,
    models: dict[tuple, tuple],
    epoch: int,
    lanes: int = 1,
    numbers: range | None = None,
    partitions: list[int] | None = None,
):
    """Row-weighted mean gradients and batch statistics of every (model, detector), for one step of an epoch.

    ``numbers`` are the batches the step takes and ``partitions`` those that hold them, if not all.
    """
    if isinstance(batches, DataFrame):
        batches = packed(batches).rdd
    by_model: dict = {}
    for (model, detector), (spec, params) in models.items():
        by_model.setdefault(model, []).append((detector, spec, params))
    shared = batches.context.broadcast(by_model)

    def flatten(params: dict, grads: dict, stats: dict) -> np.ndarray:
        parts = [grads[n] for n in net.trainable(params)]
        parts += [value for name in sorted(stats) for value in stats[name]]
        return np.concatenate([np.asarray(p, np.float64).ravel() for p in parts])

    def partial(found: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict = {}
        for lane, name, number, n, data in found:
            if numbers is not None and number not in numbers:
                continue
            x = np.frombuffer(data, np.float32).reshape(n, -1)
            for detector, spec, params in shared.value.get(name, [])[lane::lanes]:
                rng = net.seeded(spec.seed, spec.detector_id, name, int(number), epoch)
                _, grads, stats = net.loss_and_grads(spec, params, net.standardized(params, x), rng)
                total, rows = sums.get((name, detector), (0, 0))
                sums[name, detector] = (total + n * flatten(params, grads, stats), rows + n)
        for name, (total, rows) in sums.items():
            yield name, total, rows

    # model-sized: one vector a task and model, bounded with the wave
    parts = batches.context.runJob(batches, partial, partitions)
    shared.destroy()
    found: dict = {}
    for name, total, rows in parts:
        before, n = found.get(name, (0, 0))
        found[name] = (before + total, n + rows)
    for name, (total, n) in found.items():
        yield name, *unflatten(*models[name], total / n)


def unflatten(spec: DetectorSpec, params: dict, flat: np.ndarray) -> tuple[dict, dict]:
    grads, at = {}, 0
    for name in net.trainable(params):
        size = params[name].size
        grads[name] = flat[at : at + size].reshape(params[name].shape).astype(params[name].dtype)
        at += size
    stats = {}
    normalised = sorted({n.split(".")[0] for n in params if n.endswith(".gain")})
    for name in normalised:
        size = params[f"{name}.gain"].size
        stats[name] = (flat[at : at + size], flat[at + size : at + 2 * size])
        at += 2 * size
    return grads, stats
