"""Benchmark and ablation grids over runs, inlier classes and detectors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.detectors import spec as detectors
from textanomaly.detectors.spec import DetectorSpec
from textanomaly.operators import ensemble
from textanomaly.operators.contaminate import contaminate, draw_inliers, paired_splits, with_vectors
from textanomaly.operators.corpus import eligible_inliers
from textanomaly.operators.fit import MAX_GROUP_ROWS, detectors_per_task, fit_and_score
from textanomaly.operators.metrics import ranking_metrics
from textanomaly.plans import ledger
from textanomaly.plans.prepare import contents
from textanomaly.session import broadcast_if_small, settle
from textanomaly.sources.corpus import fingerprint, save_results, stage_path

GROUP = ["run", "inlier"]

# Settings shared by the detectors of every experiment.
COMMON = {"dropout_rate": 0.2, "hidden_dims": (128, 64), "batch_size": 1000, "epochs": 100}
LNE = {**COMMON, "latent_dim": 64, "robust": True, "lambda1": 0.1, "lambda2": 0.1, "lambda3": 0.2}
# The layouts compared by the hidden-layer study.
LAYOUTS = [(64, 32), (128, 64, 32), (128, 64), (256, 128, 64, 32), (512, 256, 128, 64, 32)]


def benchmark_specs(**changes) -> list[DetectorSpec]:
    """The five single detectors and the twenty members of the ensemble."""
    single = [
        detectors.base("base", **{**COMMON, **changes}),
        detectors.lne("lleae", **{**LNE, "n_neighbors": 50, **changes}),
        detectors.lne("lleae2", **{**COMMON, "latent_dim": 64, "n_neighbors": 100, **changes}),
        detectors.pruned("rae", **{**COMMON, "prune_ratio": 0.5, **changes}),
        detectors.rsr("rsrae", **{**COMMON, "latent_dim": 16, **changes}),
    ]
    return single + [detectors.lne(f"ens-{k}", **{**LNE, "n_neighbors": k, **changes}) for k in range(5, 105, 5)]


def ablation_specs(study: str, **changes) -> list[DetectorSpec]:
    """The grid of one study: ``latent``, ``hidden``, ``lambda`` or ``ensemble``."""
    near = {**LNE, "n_neighbors": 50}
    if study == "latent":
        return [detectors.lne(f"latent-{n}", **{**near, "latent_dim": n, **changes}) for n in range(2, 66, 2)]
    if study == "hidden":
        return [
            detectors.lne(f"hidden-{i}", **{**near, "hidden_dims": h, "latent_dim": h[-1], **changes})
            for i, h in enumerate(LAYOUTS)
        ]
    if study == "lambda":
        steps = [i / 10 for i in range(11)]
        return [
            detectors.lne(f"lambda-{a}-{b}-{c}", **{**near, "lambda1": a, "lambda2": b, "lambda3": c, **changes})
            for a, b, c in product(steps, steps, steps)
        ]
    if study == "ensemble":
        return [detectors.lne(f"k-{k}", **{**near, "n_neighbors": k, **changes}) for k in range(10, 101)]
    raise ValueError("study is latent, hidden, lambda or ensemble")


def drawn_inliers(
    corpus: DataFrame,
    hierarchy: DataFrame | None = None,
    mode: str = "independent",
    runs: int = 10,
    min_size: int = 100,
    classes: int = 40,
    seed: int = 0,
    test: str = "test",
    **_,
) -> DataFrame:
    """The inlier classes of every run, from the train split."""
    train = paired_splits(corpus, test).where(F.col("split") == "train")
    return settle(draw_inliers(eligible_inliers(train, mode, min_size, hierarchy), runs, classes, seed))


def splits(
    corpus: DataFrame,
    hierarchy: DataFrame | None = None,
    mode: str = "independent",
    runs: int = 10,
    nu: float = 0.1,
    split_size: int = 1000,
    min_size: int = 100,
    classes: int = 40,
    seed: int = 0,
    test: str = "test",
    inliers: DataFrame | None = None,
) -> DataFrame:
    """Contaminated train and test rows of every (run, inlier), with their vectors.

    Inlier classes are drawn from the train split, unless given, and used in both. Ids are unique
    within a split; the test split may number its rows anew.
    """
    paired = paired_splits(corpus, test)
    if inliers is None:
        inliers = drawn_inliers(corpus, hierarchy, mode, runs, min_size, classes, seed, test)
    chosen = contaminate(paired.select("doc_id", "label", "split"), inliers, mode, nu, split_size, seed, hierarchy)
    # a stand-in test split repeats train rows under its own name, so vectors are joined by split and id
    if not paired.groupBy("split", "doc_id").count().where("count > 1").isEmpty():
        raise ValueError("doc_id repeats within a split")
    return with_vectors(chosen, paired, within=("split",)).withColumn(
        "split", F.when(F.col("split") == test, "test").otherwise(F.col("split"))
    )


def group_bound(split_size: int = 1000, **_) -> int | None:
    """Groups hold at most ``split_size`` + 1 rows a split, so only large settings need counting."""
    return None if 2 * (split_size + 1) <= MAX_GROUP_ROWS else MAX_GROUP_ROWS


def grid_scores(
    corpus: DataFrame,
    hierarchy: DataFrame | None,
    mode: str,
    nu: float,
    specs: list[DetectorSpec],
    tasks: int | None = None,
    start: dict[str, dict] | None = None,
    split_options: dict | None = None,
    store: str | None = None,
    commit_cells: int = ledger.COMMIT_CELLS,
    commits: int | None = None,
    once: bool = False,
) -> tuple[DataFrame, int | None]:
    """Scores of all detectors on all groups, computed once, and the bound above which groups are counted.

    ``once`` is for callers that read test scores only, and these once: without a ``store`` no others are computed, and
    those when they are read.

    With ``store`` (``grid_path``) scores are kept there by cell, and only cells that it lacks are fitted; ``commits``
    stops after so many blocks of cells and gives the scores up to there.
    """
    split_options = split_options or {}
    inliers = drawn_inliers(corpus, hierarchy, mode, **split_options)
    rows = splits(corpus, hierarchy, mode, nu=nu, inliers=inliers, **split_options)
    bound = group_bound(**split_options)
    options = {"tasks": tasks, "max_group_rows": bound, "start": start}
    if store is None:
        cores = corpus.sparkSession.sparkContext.defaultParallelism
        per_task = detectors_per_task(len(specs), inliers.count(), cores)
        scores = fit_and_score(rows, specs, GROUP, ["y"], per_task=per_task, scored="test" if once else None, **options)
        return scores if once else settle(scores), bound
    wanted = settle(ledger.cells(inliers, specs))
    ledger.fill(lambda: rows, wanted, specs, store, ["y"], commit_cells, commits, **options)
    columns = [*[rows.schema[c] for c in (*GROUP, "split", "doc_id", "y")]]
    schema = T.StructType([*columns, T.StructField("detector_id", T.StringType()), T.StructField("score", T.DoubleType())])
    return ledger.scores(wanted, store, schema), bound


def grid_path(corpus, hierarchy, mode, nu, start, split_options, folder: str) -> str:
    """The folder of a grid's cells: another corpus, split or set of starting weights has another one."""
    settings = {
        "corpus": contents(corpus), "hierarchy": None if hierarchy is None else contents(hierarchy), "mode": mode, "nu": nu,
        "start": ledger.weights_digest(start), **split_options,
    }
    return stage_path(folder, settings)


def kept(results: DataFrame, path: str | None, *settings) -> DataFrame:
    """Results written by run next to the cells they come from, and read again."""
    if path is None:
        return results
    target = f"{path}/results-{fingerprint({'settings': settings})}"
    save_results(results, target)
    return results.sparkSession.read.schema(results.schema).parquet(target).select(*results.columns)


def described(results: DataFrame, embedding: str, nu: float, mode: str) -> DataFrame:
    return results.select(
        "model",
        "auc",
        "ap",
        F.lit(embedding).alias("embedding"),
        F.lit(float(nu)).alias("nu"),
        F.lit(mode).alias("generation"),
        "run",
        "inlier",
        *[c for c in results.columns if c not in ("model", "auc", "ap", "run", "inlier")],
    )


def benchmark(
    corpus: DataFrame,
    hierarchy: DataFrame | None = None,
    mode: str = "independent",
    nu: float = 0.1,
    embedding: str = "distill-roberta",
    combination: str = "median",
    specs: list[DetectorSpec] | None = None,
    tasks: int | None = None,
    start: dict[str, dict] | None = None,
    store: str | None = None,
    **split_options,
) -> DataFrame:
    """ROC-AUC and average precision of every model, run and inlier class.

    ``corpus(doc_id, label, split, embedding)``. Detectors named ``ens-*`` form
    the ensemble ``ens``; the others are models of their own. Groups are bounded
    by the split size, so each is fitted, scored and ranked within a task. ``start``
    has the weights by detector that training begins at. In the folder ``store`` scores
    are kept by cell and results by run, so a grid that was stopped fits only what is missing.
    """
    specs = specs or benchmark_specs()
    path = store and grid_path(corpus, hierarchy, mode, nu, start, split_options, store)
    scores, bound = grid_scores(corpus, hierarchy, mode, nu, specs, tasks, start, split_options, path)
    member = F.col("detector_id").startswith("ens-")
    tested = scores.where(F.col("split") == "test")
    single = tested.where(~member).withColumnRenamed("detector_id", "model")
    members = scores.where(member)
    scaler = ensemble.fit_score_scaler(members.where(F.col("split") == "train"), GROUP)
    scaled = ensemble.apply_score_scaler(members.where(F.col("split") == "test"), scaler, GROUP)
    combined = ensemble.combine(scaled, [*GROUP, "doc_id", "y"], combination).withColumn("model", F.lit("ens"))
    columns = [*GROUP, "model", "y", "score"]
    together = single.select(*columns).unionByName(combined.select(*columns))
    results = ranking_metrics(together, [*GROUP, "model"], ranges=1 if bound is None else None)
    return kept(described(results, embedding, nu, mode), path, embedding, combination, [s.to_json() for s in specs])


def spec_table(spark: SparkSession, specs: list[DetectorSpec]) -> DataFrame:
    """Settings of a grid as rows, in the names of the results."""
    rows = [
        (s.detector_id, s.n_neighbors, s.lambda1, s.lambda2, s.lambda3, str(list(s.hidden_dims)), s.latent_dim)
        for s in specs
    ]
    schema = (
        "detector_id string, n_neighbors int, lambda1 double, lambda2 double, lambda3 double, hidden string, latent int"
    )
    return spark.createDataFrame(rows, schema)


def ablation(
    corpus: DataFrame,
    study: str,
    hierarchy: DataFrame | None = None,
    mode: str = "contextual",
    nu: float = 0.1,
    embedding: str = "distill-roberta",
    specs: list[DetectorSpec] | None = None,
    sizes: list[int] | None = None,
    seed: int = 0,
    tasks: int | None = None,
    start: dict[str, dict] | None = None,
    store: str | None = None,
    **split_options,
) -> DataFrame:
    """Metrics of every detector of a grid; ``ensemble`` adds sub-ensembles of growing size.

    Each detector is fitted and scored once; sub-ensembles are drawn from those scores. ``start`` has the weights
    by detector that training begins at, ``store`` the folder where scores and results are kept, as in ``benchmark``.
    """
    specs = specs or ablation_specs(study)
    split_options = {"seed": seed, **split_options}
    path = store and grid_path(corpus, hierarchy, mode, nu, start, split_options, store)
    # sub-ensembles and the ranges of large groups look at scores again
    once = study != "ensemble" and group_bound(**split_options) is None
    scores, bound = grid_scores(corpus, hierarchy, mode, nu, specs, tasks, start, split_options, path, once=once)
    tested = scores.where(F.col("split") == "test")
    each = ranking_metrics(tested, [*GROUP, "detector_id"], ranges=1 if bound is None else None)
    if once and path is None:
        each = settle(each)  # one row a cell, so that no reader of the results fits again
    grid = spec_table(corpus.sparkSession, specs)
    results = each.join(broadcast_if_small(grid), "detector_id").select(
        *GROUP,
        F.lit("lleae").alias("model"),
        "auc",
        "ap",
        F.lit(1).alias("ndetector"),
        *grid.columns[1:],
    )
    if study == "ensemble":
        first = specs[0]
        scaler = ensemble.fit_score_scaler(scores.where(F.col("split") == "train"), GROUP)
        scaled = ensemble.apply_score_scaler(tested, scaler, GROUP)
        draws = ensemble.draw_detectors(scores, sizes or list(range(2, 91)), seed)
        drawn = ensemble.sub_ensemble(scaled, [*GROUP, "doc_id", "y"], draws)
        curve = ranking_metrics(drawn, [*GROUP, "draw"], ranges=1 if bound is None else None).select(
            *GROUP,
            F.lit("ens").alias("model"),
            "auc",
            "ap",
            F.col("draw").alias("ndetector"),
            F.lit(-1).alias("n_neighbors"),
            F.lit(first.lambda1).alias("lambda1"),
            F.lit(first.lambda2).alias("lambda2"),
            F.lit(first.lambda3).alias("lambda3"),
            F.lit(str(list(first.hidden_dims))).alias("hidden"),
            F.lit(first.latent_dim).alias("latent"),
        )
        results = results.unionByName(curve)
    return kept(described(results, embedding, nu, mode), path, embedding, study, sizes, [s.to_json() for s in specs])
