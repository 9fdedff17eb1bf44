"""Measured broadcasts, settled tables, and the same results without any broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textanomaly import session
from textanomaly.detectors import spec as detectors
from textanomaly.operators import contaminate as tac
from textanomaly.operators import corpus as ops
from textanomaly.operators import ensemble, fit, metrics, neighbours, scale
from textanomaly.operators.score import score


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_size_is_measured_before_a_broadcast(spark):
    big, small = spark.range(100_000).withColumn("v", F.lit("x" * 50)), spark.range(10).withColumnRenamed("id", "k")
    size = session.measured_bytes(big)
    assert 100_000 * 50 < size < 100_000 * 120
    assert session.measured_bytes(spark.range(5).select(F.array_repeat(F.lit(1.0), 100).alias("a"))) > 5 * 800
    assert session.measured_bytes(spark.range(0)) == 0
    hinted = "ResolvedHint"
    assert hinted in session.broadcast_if_small(small)._jdf.queryExecution().analyzed().toString()
    assert hinted not in session.broadcast_if_small(big, size - 1)._jdf.queryExecution().analyzed().toString()


def test_settled_tables_have_no_lineage_and_join_with_their_source(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 3)
    counts = session.settle(df.groupBy("g").count())
    assert "Range" not in plan(counts)
    joined = session.attach(df, counts, ["g"])
    assert joined.count() == 20 and joined.columns == ["id", "g", "count"]


def test_attach_matches_null_keys_and_works_without_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "g string, v int")
    side = spark.createDataFrame([("a", 10), (None, 20)], "g string, w int")
    got = {(r["g"], r["w"]) for r in session.attach(df, side, ["g"], "left").collect()}
    assert got == {("a", 10), (None, 20), ("z", None)}
    assert session.attach(df, side, ["g"]).count() == 2
    whole = side.agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    assert {(r["w"], r["n"]) for r in session.attach(df, whole, []).collect()} == {(30, 2)}


def test_few_splits_are_spread_and_many_are_not(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.widen(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 3)
    assert session.widen(many) is many


def results(spark):
    """Rows of the operators that join a measured side."""
    rng = np.random.default_rng(0)
    data = [
        (i, "hot" if i % 3 else f"l{i % 4}", "train" if i % 2 else "test", v.tolist())
        for i, v in enumerate(rng.standard_normal((240, 4)))
    ]
    df = spark.createDataFrame(data, "doc_id int, label string, split string, embedding array<float>")
    tree = spark.createDataFrame([("hot", 0), ("l0", 0), ("l1", 1), ("l2", 1), ("l3", 0)], "label string, parent int")
    inliers = tac.draw_inliers(ops.eligible_inliers(df, "contextual", 5, tree), 2, 3, 1)
    scored = df.withColumn("score", F.col("embedding")[0].cast("double")).withColumn("y", (F.col("doc_id") % 5 == 0).cast("int"))
    model = fit.fit_detectors(df, [detectors.lne(hidden_dims=(3,), latent_dim=2, epochs=1, batch_size=300)], ["label"])
    frames = [
        tac.contaminate(df, inliers, "contextual", 0.2, 30, 1, tree),
        tac.contaminate(df, inliers, "independent", 0.2, 30, 1, tree),
        ops.cap_per_label(df.select("doc_id", "label"), 9, 2),
        metrics.ranking_metrics(scored, ["label"], ranges=9),
        ensemble.threshold(scored, ["label"], 0.2, ranges=9),
        neighbours.knn(df, ["label"], 2, 40),
        scale.apply_scaler(df, scale.fit_scaler(df, ["label"]), ["label"]).select("doc_id", F.posexplode("embedding")),
        score(df, model, ["label"], batch_size=50, max_model_bytes=0),
    ]
    found = []
    for frame in frames:
        rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect()]
        found.append(sorted(rows, key=repr))
    return found


def test_results_do_not_depend_on_broadcasts(spark, monkeypatch):
    with_broadcasts = results(spark)
    monkeypatch.setattr(session, "MAX_BROADCAST_BYTES", -1)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without = results(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert all(len(rows) for rows in with_broadcasts)
    assert without == with_broadcasts


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
