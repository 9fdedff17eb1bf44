"""Detector fits, scoring and the experiment grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.detectors import spec as detectors
from textanomaly.operators.contaminate import with_vectors
from textanomaly.operators.fit import fit_and_score, fit_detector_large, fit_detectors, model_rows, model_schema
from textanomaly.operators.metrics import summary
from textanomaly.operators.score import score
from textanomaly.plans import experiments
from textanomaly.queries.shared import CORPUS, DIM, SEED, vector_corpus, vector_hierarchy
from textanomaly.queries.splits import NU, contaminated

GROUP = ["run", "inlier"]
SHORT = {"epochs": 5, "batch_size": 1000, "hidden_dims": (16, 8), "dropout_rate": 0.2}
# labels of the small tables have about 20 rows a split; all else in the grids is as in full experiments, but for epochs where given
GRID = {"min_size": 15, "seed": SEED}

SPECS = {
    "fit_base": detectors.base(**SHORT),
    "fit_pruned": detectors.pruned(**SHORT),
    "fit_masked": detectors.masked(**{**SHORT, "dropout_rate": 0.0}),
    "fit_rsr": detectors.rsr(**SHORT, latent_dim=4),
    "fit_lne": detectors.lne(**SHORT, latent_dim=4, n_neighbors=5, robust=True),
}


def split_rows(spark, folder):
    corpus = vector_corpus(spark, folder)
    return with_vectors(contaminated(corpus, "contextual", vector_hierarchy(corpus)), corpus.drop("label", "split"))


def fitted(spec):
    def query(spark, folder):
        train = split_rows(spark, folder).where("split = 'train'")
        return fit_detectors(train, [spec], GROUP, max_group_rows=None).drop("spec")

    return query


def fit_large(spark, folder):
    """One model for the whole vector table."""
    spec = detectors.base("large", **{**SHORT, "batch_size": 256, "batches_per_step": 8, "epochs": 3})
    return fit_detector_large(vector_corpus(spark, folder), spec).drop("spec")


def fit_large_by_label(spark, folder):
    """One model for every label, all trained by the same jobs."""
    spec = detectors.lne("large", **{**SHORT, "batch_size": 64, "batches_per_step": 4, "epochs": 3, "latent_dim": 4})
    return fit_detector_large(vector_corpus(spark, folder), spec, ["label"]).drop("spec")


def fit_paths_agree(spark, folder):
    """Weights of every label's detectors that differ between a fit in one task and a fit by all tasks."""
    corpus = vector_corpus(spark, folder).where("split = 'train'")
    results = []
    for name, spec in SPECS.items():
        spec = spec.but(epochs=1, batch_size=16, activation="tanh", batchnorm=False)
        one, many = (
            fit_detectors(corpus, [spec], ["label"], max_group_rows=bound).select("label", "name", "data")
            for bound in (None, 0)
        )
        many = many.withColumnRenamed("data", "other")
        gaps = F.zip_with("data", "other", lambda a, b: F.coalesce(F.abs(a - b), F.lit(1.0)))
        apart = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, gap: n + (gap > 1e-4).cast("long"))
        both = one.join(many, ["label", "name"], "full").withColumn("apart", F.coalesce(apart, F.lit(1).cast("long")))
        results.append(both.agg(F.countDistinct("label").alias("models"), F.sum("apart").alias("differing")).select(F.lit(name).alias("detector"), "models", "differing"))
    return reduce(DataFrame.unionByName, results)


def split_ids(spark, folder):
    """Rows whose ids begin anew in each split: each chosen row and the first number of its own vector."""
    corpus = vector_corpus(spark, folder).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    rows = experiments.splits(corpus, None, "independent", nu=NU, **GRID)
    own = corpus.select("split", "doc_id", F.col("embedding")[0].alias("first"))
    joined = rows.join(own, ["split", "doc_id"])
    return joined.groupBy("split").agg(F.sum((F.col("embedding")[0] != F.col("first")).cast("long")).alias("foreign_vectors"))


def fit_score(spark, folder):
    return fit_and_score(split_rows(spark, folder), list(SPECS.values()), GROUP, carry=["y"], max_group_rows=None)


def fit_then_score(spark, folder):
    rows = split_rows(spark, folder)
    models = fit_detectors(rows.where("split = 'train'"), list(SPECS.values()), GROUP)
    return score(rows, models, GROUP, carry=["split", "y"], within=["split"])


def encoder_weight(i, q):
    return (i * (q + 3) % 7 - 3) / 10


def fixed_models(spark):
    """A one-layer network with given weights instead of trained ones."""
    import numpy as np

    spec = detectors.base("fixed", hidden_dims=(2,), batchnorm=False, dropout_rate=0.0)
    encode = np.array([[encoder_weight(i, q) for i in range(DIM)] for q in range(2)])
    params = {
        "enc0.W": encode,
        "enc0.b": np.array([0.05, -0.05]),
        "dec0.W": encode.T,
        "dec0.b": np.zeros(DIM),
    }
    rows = [(*row[:4], [float(v) for v in row[4]]) for row in model_rows(spec, params)]
    return spark.createDataFrame(rows, model_schema(spark.range(1), []))


def score_fixed(spark, folder):
    corpus = vector_corpus(spark, folder)
    return score(corpus, fixed_models(spark), []).withColumn("score", F.round("score", 4))


def benchmark(spark, folder):
    corpus = vector_corpus(spark, folder)
    specs = experiments.benchmark_specs(epochs=5)
    return experiments.benchmark(corpus, vector_hierarchy(corpus), "contextual", NU, "given", specs=specs, **GRID)


def benchmark_summary(spark, folder):
    return summary(benchmark(spark, folder))


def ablation(study, **changes):
    """A study with the settings of full experiments, but for ``changes``."""

    def query(spark, folder):
        corpus = vector_corpus(spark, folder)
        specs = experiments.ablation_specs(study, **changes)
        return experiments.ablation(corpus, study, vector_hierarchy(corpus), "contextual", NU, "given", specs=specs, **GRID)

    return query


HIDDEN = ", ".join(
    f"greatest(0, list_sum(list_transform(range(1, {DIM + 1}), lambda i: x[i] * ((i - 1) * ({q} + 3) % 7 - 3) / 10.0::double)) + {b}) as h{q}"
    for q, b in ((0, 0.05), (1, -0.05))
)

QUERIES = {
    **{name: fitted(spec) for name, spec in SPECS.items()},
    "fit_paths_agree": fit_paths_agree,
    "split_ids": split_ids,
    "fit_large": fit_large,
    "fit_large_by_label": fit_large_by_label,
    "fit_and_score": fit_score,
    "score_models": fit_then_score,
    "score_fixed_weights": score_fixed,
    "benchmark": benchmark,
    "benchmark_summary": benchmark_summary,
    "ablation_latent": ablation("latent"),
    "ablation_hidden": ablation("hidden", epochs=3),
    "ablation_lambda": ablation("lambda"),
    "ablation_ensemble": ablation("ensemble", epochs=3),
}

ORACLES = {
    "fit_paths_agree": f"""select unnest({list(SPECS)}) as detector,
  (select count(distinct label) from embeddings where vec_id % 2 = 0) as models, 0::bigint as differing""",
    "split_ids": """select case when vec_id % 2 = 0 then 'train' else 'test' end as split, 0::bigint as foreign_vectors
from embeddings group by 1""",
    "score_fixed_weights": f"""with {CORPUS},
coded as (select doc_id, x, {HIDDEN} from (select doc_id, embedding as x from corpus))
select doc_id, 'fixed' as detector_id, round(sqrt(list_sum(list_transform(range(1, {DIM + 1}), lambda i:
  power(greatest(0, h0 * ((i - 1) * 3 % 7 - 3) / 10.0::double + h1 * ((i - 1) * 4 % 7 - 3) / 10.0::double) - x[i], 2)))), 4) as score
from coded""",
}
