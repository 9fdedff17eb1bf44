"""Neighbours, losses, fitting and scoring as jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textanomaly.detectors import net
from textanomaly.detectors import spec as detectors
from textanomaly.operators import fit as fitting
from textanomaly.operators import losses, neighbours
from textanomaly.operators import score as scoring
from textanomaly.operators.metrics import roc_auc
from textanomaly.operators.score import rebuilt, score
from textanomaly.plans import experiments

SMALL = {"hidden_dims": (6, 4), "dropout_rate": 0.0, "batch_size": 500, "epochs": 4, "learning_rate": 1e-2}
SPECS = [
    detectors.base(**SMALL),
    detectors.pruned(**SMALL),
    detectors.masked(**SMALL),
    detectors.rsr(**SMALL, latent_dim=2),
    detectors.lne(**SMALL, latent_dim=3, n_neighbors=4, robust=True),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = []
    for run, inlier, size in ((0, "a", 40), (0, "b", 30), (1, "a", 25)):
        for split in ("train", "test"):
            x = rng.standard_normal((size, 5))
            data += [(run, inlier, split, len(data) + i, int(i < 3), v.tolist()) for i, v in enumerate(x)]
    schema = "run int, inlier string, split string, doc_id int, y int, embedding array<float>"
    return spark.createDataFrame(data, schema)


KEYS = ["run", "inlier"]


def as_dict(frame):
    return {
        (r["run"], r["inlier"], r["split"], r["doc_id"], r["detector_id"]): r["score"] for r in frame.collect()
    }


def close(left, right, tolerance=1e-4):
    assert left.keys() == right.keys() and len(left) > 0
    assert np.allclose([left[k] for k in left], [right[k] for k in left], atol=tolerance)


def test_knn_by_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (60, 2)).astype(float)  # many ties
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "doc_id int, g int, embedding array<float>")
    for k, size in ((3, 1000), (3, 10), (40, 1000)):
        batched = {r["doc_id"]: (r["g"], r["batch"]) for r in neighbours.hash_batches(df, ["g"], size).collect()}
        got = {}
        for r in neighbours.knn(df, ["g"], k, size).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["nbr"], r["dist"]))
        for i in range(60):
            mates = [j for j in range(60) if batched[j] == batched[i]]
            far = {j: np.inf if i == j else float(np.linalg.norm(x[i] - x[j])) for j in mates}
            best = sorted(mates, key=lambda j: (far[j], j))[: min(k, len(mates))]
            want = [(n + 1, j, far[j]) for n, j in enumerate(best)]
            assert [(a, b) for a, b, _ in sorted(got[i])] == [(a, b) for a, b, _ in want]
            assert np.allclose([c for _, _, c in sorted(got[i])], [c for _, _, c in want])


def test_batches_of_a_hot_key_stay_near_the_size(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 19990, "hot").otherwise("cold").alias("g"))
    sizes = neighbours.hash_batches(df, ["g"], 500).groupBy("g", "batch").count().collect()
    assert max(r["count"] for r in sizes) < 650 and len([r for r in sizes if r["g"] == "hot"]) == 40
    assert [r["count"] for r in sizes if r["g"] == "cold"] == [10]


def test_neighbour_sum(spark):
    x = np.arange(8.0).reshape(4, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id int, embedding array<double>")
    nbrs = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (2, 2)], "id int, nbr int")
    weights = np.array([[1.0, 0, 2], [0.5, -1, 0]])
    plain = {r["id"]: list(r["local_sum"]) for r in neighbours.neighbour_sum(df, nbrs).collect()}
    assert plain == {0: [8, 10], 1: [4, 5], 2: [4, 5]}
    mapped = {r["id"]: list(r["local_sum"]) for r in neighbours.neighbour_sum(df, nbrs, weights).collect()}
    assert np.allclose(mapped[0], (x[1] + x[3]) @ weights)


def test_losses(spark):
    rng = np.random.default_rng(2)
    x, y, z, a = (rng.standard_normal(s) for s in ((9, 4), (9, 4), (9, 2), (4, 2)))
    df = spark.createDataFrame(
        [tuple(v.tolist() for v in row) for row in zip(x, y, z)], "x array<double>, y array<double>, z array<double>"
    )
    gap = x - y
    norms = {"MSE": (gap**2).sum(1).mean(), "l1": np.abs(gap).sum(1).mean(), "LAD": np.linalg.norm(gap, axis=1).mean()}
    for kind, value in norms.items():
        assert losses.recon_error(df, "x", "y", kind).first()["error"] == pytest.approx(value)
    back = np.linalg.norm(x - z @ a.T, axis=1).mean()
    assert losses.subspace_error(df, "x", "z", a, "L2").first()["error"] == pytest.approx(back)
    cells = [(i, j, float(a[i, j])) for i in range(4) for j in range(2)]
    long = spark.createDataFrame(cells, "i int, j int, v double")
    assert losses.ortho_error(long).first()["error"] == pytest.approx(((a.T @ a - np.eye(2)) ** 2).mean())
    apart = spark.createDataFrame([(0, 0, 2.0), (1, 1, 3.0)], "i int, j int, v double")
    assert losses.ortho_error(apart).first()["error"] == pytest.approx((9 + 64) / 4)
    with pytest.raises(ValueError):
        losses.recon_error(df, "x", "y", "huber")


def test_fit_then_score_equals_fit_and_score(rows):
    train = rows.where("split = 'train'")
    models = fitting.fit_detectors(train, SPECS, KEYS, per_task=2)
    direct = as_dict(fitting.fit_and_score(rows, SPECS, KEYS, carry=["y"], per_task=3))
    broadcast = as_dict(score(rows, models, KEYS, carry=["split"], within=["split"]))
    grouped = as_dict(score(rows, models, KEYS, carry=["split"], within=["split"], max_model_bytes=0))
    close(direct, broadcast)
    close(direct, grouped)
    assert len(direct) == rows.count() * len(SPECS)
    again = as_dict(fitting.fit_and_score(rows.repartition(5), SPECS, KEYS, per_task=5, tasks=2))
    assert again == direct


@pytest.mark.parametrize("bound", [None, 0])
def test_scores_of_the_test_split_only(rows, bound):
    every = fitting.fit_and_score(rows, SPECS[:2], KEYS, ["y"], max_group_rows=bound).where("split = 'test'")
    tested = fitting.fit_and_score(rows, SPECS[:2], KEYS, ["y"], max_group_rows=bound, scored="test")
    rounded = F.round("score", 4).alias("score")
    assert sorted(every.withColumn("score", rounded).collect()) == sorted(tested.withColumn("score", rounded).collect())


def test_scores_without_keys_in_both_ways(rows):
    train = rows.where("split = 'train'")
    models = fitting.fit_detectors(train, SPECS[:1] + SPECS[3:], [])
    results = [
        {(r["doc_id"], r["detector_id"]): r["score"] for r in score(rows, models, [], batch_size=30, max_model_bytes=b).collect()}
        for b in (1 << 30, 0)
    ]
    close(*results)
    assert len(results[0]) == rows.count() * 3


def test_scores_need_models(rows):
    models = fitting.fit_detectors(rows, SPECS[:1], KEYS).limit(0)
    with pytest.raises(ValueError, match="fit"):
        score(rows, models, KEYS)


@pytest.mark.parametrize("spec", [SPECS[0], SPECS[1], SPECS[3], SPECS[4], SPECS[0].but(standardize=True, batchnorm=False)])
def test_large_fit_with_one_batch_equals_the_grouped_fit(rows, spec):
    train = rows.where("split = 'train'")
    # where a gradient is zero (relu units always active, shifts of standardised data) Adam steps on rounding noise
    spec = spec.but(activation="tanh")
    grouped = fitting.fit_detectors(train, [spec], KEYS)
    large = fitting.fit_detectors(train, [spec], KEYS, max_group_rows=30)  # only the group of 40 is large
    want = {(r["run"], r["inlier"], r["name"]): r["data"] for r in grouped.collect()}
    got = {(r["run"], r["inlier"], r["name"]): r["data"] for r in large.collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert np.allclose(got[key], want[key], atol=2e-3), key


@pytest.mark.parametrize("spec", [s.but(batch_size=12, epochs=2, activation="tanh") for s in SPECS])
@pytest.mark.parametrize("together", [1, 2])
def test_where_a_group_is_trained_does_not_change_its_weights(rows, spec, together):
    # shifts before a normalisation have no gradient but rounding noise, which Adam scales up
    spec = spec.but(batches_per_step=together, batchnorm=spec.batchnorm and spec.family != "masked")
    train = rows.where("split = 'train'")
    in_task = fitting.fit_detectors(train, [spec], KEYS, max_group_rows=None)
    by_all = fitting.fit_detectors(train, [spec], KEYS, max_group_rows=0)
    want, got = ({(r["run"], r["inlier"], r["name"]): r["data"] for r in m.collect()} for m in (in_task, by_all))
    assert got.keys() == want.keys() and want
    for key in want:
        assert np.allclose(got[key], want[key], atol=1e-4), key


def test_models_beyond_the_driver_are_trained_in_waves(rows):
    train, spec = rows.where("split = 'train'"), SPECS[0].but(epochs=1)
    one = fitting.fit_detector_large(train, spec, KEYS)
    waves = fitting.fit_detector_large(train, spec, KEYS, max_driver_bytes=1)
    order = [*KEYS, "name"]
    assert one.orderBy(order).collect() == waves.orderBy(order).collect()


def test_neighbour_detectors_score_in_batches_of_their_own_size(rows):
    spec = SPECS[4].but(batch_size=9)
    direct = as_dict(fitting.fit_and_score(rows, [spec, SPECS[4].but(detector_id="other")], KEYS, carry=["y"]))
    models = fitting.fit_detectors(rows.where("split = 'train'"), [spec, SPECS[4].but(detector_id="other")], KEYS)
    for bound in (1 << 30, 0):
        close(direct, as_dict(score(rows, models, KEYS, carry=["split"], within=["split"], max_model_bytes=bound)))


def test_rows_of_a_key_without_a_model_are_an_error(rows):
    models = fitting.fit_detectors(rows.where("split = 'train'"), SPECS[:1], KEYS)
    first = models.first()
    for bound in (1 << 30, 0):
        with pytest.raises(ValueError, match="not fitted"):
            score(rows, models.where(F.col("inlier") != first["inlier"]), KEYS, max_model_bytes=bound)


def test_large_fit_over_many_batches(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 3)) @ rng.standard_normal((3, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id int, embedding array<float>")
    spec = detectors.base("big", **{**SMALL, "batch_size": 100, "activation": "tanh"})

    def error(models):
        return score(df, models, []).agg(F.avg("score")).first()[0]

    start, late = (fitting.fit_detector_large(df, spec.but(epochs=n, batches_per_step=5)) for n in (1, 12))
    assert error(late) < error(start)
    params = dict((s.detector_id, p) for s, p in rebuilt(late.toPandas()))["big"]
    assert (params["enc0.var"] > 0).all() and not np.allclose(params["enc0.mean"], 0)
    one = fitting.fit_detector_large(df, spec.but(epochs=2), tasks=1).orderBy("name").collect()
    many = fitting.fit_detector_large(df.repartition(6), spec.but(epochs=2), tasks=5).orderBy("name").collect()
    for a, b in zip(one, many):
        assert a["name"] == b["name"] and np.allclose(a["data"], b["data"], atol=1e-5)


def test_gradient_sums_are_the_row_weighted_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 5)).astype(np.float32)
    spec = detectors.base("g", **{**SMALL, "batchnorm": False})
    params = net.initial(spec, 5, np.random.default_rng(0))
    df = spark.createDataFrame([(0, "m", i % 3, v.tolist()) for i, v in enumerate(x)], "lane int, model string, batch long, embedding array<float>")
    laid = df.repartition(2, "batch").sortWithinPartitions("lane", "model", "batch")
    ((name, grads, stats),) = fitting.gradient_sums(laid, {("m", "g"): (spec, params)}, 0)
    _, want, _ = net.loss_and_grads(spec, params, x, rng)
    assert name == ("m", "g") and stats == {}
    assert all(np.allclose(grads[k], want[k], atol=1e-6) for k in want)


def test_a_step_runs_on_the_partitions_of_its_batches(rows, monkeypatch):
    spec = SPECS[0].but(batch_size=4, epochs=1)
    asked, real = [], fitting.gradient_sums
    monkeypatch.setattr(fitting, "gradient_sums", lambda *a: asked.append((a[0].getNumPartitions(), a[4], a[5])) or real(*a))
    fitting.fit_detectors(rows.where("split = 'train'"), [spec], KEYS, max_group_rows=0).collect()
    # 10, 8 and 7 batches a group; a step takes one of each
    assert len(asked) == 10 and all(len(places) <= 3 < every for every, _, places in asked)


def test_large_groups_are_fitted_and_scored_too(rows):
    few = as_dict(fitting.fit_and_score(rows, [SPECS[0], SPECS[4]], KEYS))
    split = as_dict(fitting.fit_and_score(rows, [SPECS[0], SPECS[4]], KEYS, max_group_rows=70))
    close(few, split, 5e-2)


def test_detector_ids_must_differ(rows):
    with pytest.raises(ValueError):
        fitting.fit_detectors(rows, [SPECS[0], SPECS[0]], KEYS)


def test_experiment_grids():
    specs = experiments.benchmark_specs()
    assert [s.detector_id for s in specs[:5]] == ["base", "lleae", "lleae2", "rae", "rsrae"] and len(specs) == 25
    assert [s.n_neighbors for s in specs[5:]] == list(range(5, 105, 5))
    assert {s.epochs for s in specs} == {100} and specs[3].prune_ratio == 0.5 and specs[4].latent_dim == 16
    sizes = {"latent": 32, "hidden": 5, "lambda": 1331, "ensemble": 91}
    assert {k: len(experiments.ablation_specs(k)) for k in sizes} == sizes
    with pytest.raises(ValueError):
        experiments.ablation_specs("other")


def planted(spark):
    """Classes on separate low-dimensional planes, so other classes are easy to tell apart."""
    rng = np.random.default_rng(6)
    data = []
    for label in range(4):
        x = rng.standard_normal((120, 3)) @ rng.standard_normal((3, 12)) + 2 * rng.standard_normal(12)
        data += [(len(data) + i, label, "test" if i % 2 else "train", v.tolist()) for i, v in enumerate(x)]
    corpus = spark.createDataFrame(data, "doc_id int, label int, split string, embedding array<float>")
    tree = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "label int, parent int")
    return corpus, tree


def test_benchmark_and_ablation(spark):
    corpus, tree = planted(spark)
    changes = {"hidden_dims": (8, 4), "latent_dim": 3, "epochs": 40, "learning_rate": 1e-2}
    specs = [s.but(**{k: v for k, v in changes.items() if k != "latent_dim" or s.latent_dim}) for s in experiments.benchmark_specs()]
    options = {"runs": 1, "split_size": 60, "min_size": 30, "seed": 3}
    results = experiments.benchmark(corpus, tree, "contextual", 0.1, specs=specs[:7], **options)
    assert results.columns == ["model", "auc", "ap", "embedding", "nu", "generation", "run", "inlier"]
    found = results.collect()
    assert len(found) == 4 * 6 and {r["model"] for r in found} == {"base", "lleae", "lleae2", "rae", "rsrae", "ens"}
    mean = {m: np.mean([r["auc"] for r in found if r["model"] == m]) for m in {r["model"] for r in found}}
    assert mean["base"] > 0.6, mean
    study = experiments.ablation(
        corpus, "ensemble", tree, specs=[s.but(epochs=2, hidden_dims=(8, 4), latent_dim=3) for s in experiments.ablation_specs("ensemble")[:4]],
        sizes=[2, 3], **options,
    )
    assert study.columns[-7:] == ["ndetector", "n_neighbors", "lambda1", "lambda2", "lambda3", "hidden", "latent"]
    found = study.collect()
    assert len(found) == 4 * (4 + 2)
    assert {(r["model"], r["ndetector"], r["n_neighbors"]) for r in found} == {
        *[("lleae", 1, k) for k in (10, 11, 12, 13)], ("ens", 2, -1), ("ens", 3, -1)
    }
    assert {r["hidden"] for r in found} == {"[8, 4]"}


def test_planted_outliers_are_found(spark):
    rng = np.random.default_rng(8)
    inside = rng.standard_normal((150, 2)) @ rng.standard_normal((2, 10))
    x = np.concatenate([inside, 3 * rng.standard_normal((15, 10))])
    data = [(0, "a", "train" if i % 2 else "test", i, int(i >= 150), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "run int, inlier string, split string, doc_id int, y int, embedding array<float>")
    spec = detectors.base(**{**SMALL, "epochs": 60, "activation": "tanh"})
    scores = fitting.fit_and_score(df, [spec], KEYS, carry=["y"]).where("split = 'test'")
    assert roc_auc(scores, ["detector_id"]).first()["auc"] > 0.8


def test_blocks_and_chunks_score_alike(rows, monkeypatch):
    """Many blocks of rows and a chunk a detector give the scores of one block and one chunk."""
    specs = [*SPECS, *(s.but(detector_id=f"{s.detector_id}-b") for s in SPECS)]
    models = fitting.fit_detectors(rows.where("split = 'train'"), specs, KEYS)
    options = {"carry": ["split"], "within": ["split"], "batch_size": 10, "max_model_bytes": 0}
    whole = as_dict(score(rows, models, KEYS, **options))
    monkeypatch.setattr(scoring, "BLOCK_ROWS", 20)
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 1)
    close(whole, as_dict(score(rows, models, KEYS, **options)))


def test_training_begins_at_given_weights(rows):
    spec = SPECS[0].but(epochs=0)
    given = net.initial(spec, len(rows.first()["embedding"]), np.random.default_rng(5))
    for bound in (None, 0):
        found = fitting.fit_detectors(rows, [spec], KEYS, max_group_rows=bound, start={spec.detector_id: given})
        for row in found.collect():
            assert np.allclose(row["data"], given[row["name"]].ravel())
    with pytest.raises(ValueError, match="features"):
        net.starting(spec, 3, np.random.default_rng(0), given)


def test_chunks_follow_from_groups_and_cores():
    assert fitting.detectors_per_task(25, 1000, 8) == 25  # groups enough: rows are copied once
    assert fitting.detectors_per_task(25, 1, 8) == 1
    assert fitting.detectors_per_task(1331, 400, 8) == 1331
    assert fitting.detectors_per_task(25, 0, 1) == 1


@pytest.mark.parametrize("study", ["latent", "hidden", "lambda", "ensemble"])
def test_studies_take_all_runs_and_classes(spark, monkeypatch, study):
    from textanomaly.queries import detect

    asked = {}
    monkeypatch.setattr(experiments, "ablation", lambda *a, **options: asked.update(options))
    monkeypatch.setattr(detect, "vector_corpus", lambda *a: None)
    monkeypatch.setattr(detect, "vector_hierarchy", lambda *a: None)
    detect.QUERIES[f"ablation_{study}"](spark, "")
    assert asked.get("runs", 10) == 10 and asked.get("classes", 40) == 40 and asked.get("split_size", 1000) == 1000


def test_detectors_of_all_shapes_take_the_same_steps(rows, monkeypatch):
    many = [s.but(detector_id=f"{s.family}-{w}", hidden_dims=(w, 4), batch_size=12, activation="tanh", batchnorm=False) for s in SPECS for w in (6, 9)]
    many.append(many[0].but(detector_id="short", epochs=1))
    train = rows.where("split = 'train'")
    steps, layouts = [], []
    real, layout = fitting.gradient_sums, fitting._layout
    monkeypatch.setattr(fitting, "gradient_sums", lambda *a: steps.append(len(a[1])) or real(*a))
    monkeypatch.setattr(fitting, "_layout", lambda *a: layouts.append(a) or layout(*a))
    together = fitting.fit_detectors(train, many, KEYS, max_group_rows=0).collect()
    # the largest group has 40 rows, so 4 batches a model and epoch; 3 groups of 11 detectors, 10 of them to the end
    assert len(layouts) == 1 and steps == [33] * 4 + [30] * 12
    apart = fitting.fit_detectors(train, many, KEYS, max_group_rows=None).collect()
    key = lambda r: (r["run"], r["inlier"], r["detector_id"], r["name"])
    got, want = ({key(r): r["data"] for r in table} for table in (together, apart))
    assert got.keys() == want.keys()
    for name in want:
        assert np.allclose(got[name], want[name], atol=1e-4), name


def test_wanted_detectors_only(rows):
    specs = [SPECS[0].but(epochs=1), SPECS[3].but(epochs=1)]
    wanted = rows.sparkSession.createDataFrame([(0, "a", "base"), (0, "b", "rsr"), (1, "a", "base"), (1, "a", "rsr")], "run int, inlier string, detector_id string")
    for bound in (None, 0):
        found = fitting.fit_and_score(rows, specs, KEYS, wanted=wanted, max_group_rows=bound, per_task=1)
        got = {tuple(r) for r in found.select(*KEYS, "detector_id").distinct().collect()}
        assert got == {tuple(r) for r in wanted.collect()}
