"""Metrics, quantiles, scaling and ensembles against small exact answers."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from textanomaly.detectors.spec import base
from textanomaly.operators import ensemble, metrics, ranges, scale
from textanomaly.operators.quantile import quantile


def auc_by_pairs(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([(p > n) + 0.5 * (p == n) for p, n in product(pos, neg)]))


def ap_by_thresholds(y, s):
    if not y.sum():
        return None
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        chosen = s >= t
        recall = y[chosen].sum() / y.sum()
        total += (recall - last) * y[chosen].mean()
        last = recall
    return total


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("hot", 900), ("b", 40), ("c", 7)):
        y = rng.integers(0, 2, n)
        s = np.round(rng.standard_normal(n) + y, 1)
        if g == "hot":
            s[: n // 3] = 0.5  # a third of the group shares one score
        rows += [(g, int(a), float(b)) for a, b in zip(y, s)]
    rows += [("one", 0, 1.0), ("one", 0, 2.0), ("all", 1, 1.0), ("all", 1, 3.0), (None, 1, 2.0), (None, 0, 1.0)]
    return spark.createDataFrame(rows, "g string, y int, score double"), rows


@pytest.mark.parametrize("pieces", [None, 1, 4, 64, 1024])
def test_ranking_metrics(scored, pieces):
    df, rows = scored
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"], ranges=pieces).collect()}
    for g in {r[0] for r in rows}:
        y = np.array([r[1] for r in rows if r[0] == g])
        s = np.array([r[2] for r in rows if r[0] == g])
        for name, value in (("auc", auc_by_pairs(y, s)), ("ap", ap_by_thresholds(y, s))):
            assert got[g][name] == (None if value is None else pytest.approx(value, abs=1e-12)), (g, name)


def test_metrics_without_keys_and_by_symmetry(scored):
    df, rows = scored
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for pieces in (1, 16):
        row = metrics.ranking_metrics(df, [], ranges=pieces).first()
        assert row["auc"] == pytest.approx(auc_by_pairs(y, s)) and row["ap"] == pytest.approx(ap_by_thresholds(y, s))
    plain = metrics.roc_auc(df, [], ranges=4).first()["auc"]
    turned = metrics.roc_auc(df.withColumn("score", -F.col("score")), [], ranges=4).first()["auc"]
    bent = metrics.roc_auc(df.withColumn("score", F.exp("score")), [], ranges=4).first()["auc"]
    assert turned == pytest.approx(1 - plain) and bent == pytest.approx(plain)
    assert metrics.average_precision(df, ["g"]).columns == ["g", "ap"]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 0.999, 1.0])
@pytest.mark.parametrize("pieces", [1, 9, 400])
def test_quantile(scored, q, pieces):
    df, rows = scored
    df = df.unionByName(df.limit(1).withColumn("score", F.lit(None).cast("double")))
    got = {r["g"]: r["quantile"] for r in quantile(df, ["g"], "score", q, ranges=pieces).collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(np.quantile([r[2] for r in rows if r[0] == g], q), abs=1e-12)


def test_number_of_ranges_follows_the_largest_group(scored, monkeypatch):
    df, _ = scored
    assert ranges.ranges_needed(df, ["g"]) == 1
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 100)
    assert ranges.ranges_needed(df, ["g"]) == 9
    assert ranges.ranges_needed(df.limit(0), []) == 1
    monkeypatch.setattr(ranges, "MAX_RANGES", 5)
    assert ranges.ranges_needed(df, ["g"]) == 9
    placed = ranges.with_range(df.where("g = 'hot'"), ["g"], "score", 9)
    numbered = placed.groupBy("range").agg(F.min("score").alias("low"), F.max("score").alias("high")).orderBy("range")
    spans = [(r["low"], r["high"]) for r in numbered.collect()]
    assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_group_of_more_ranges_than_a_level_has(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 2)
    monkeypatch.setattr(ranges, "MAX_RANGES", 16)
    rng, n = np.random.default_rng(3), 600
    y = rng.integers(0, 2, n)
    s = np.where(np.arange(n) % 5 == 0, 0.25, rng.random(n).round(4) + y / 4)
    rows = [("hot", int(a), float(b)) for a, b in zip(y, s)] + [("cold", 0, 1.0), ("cold", 1, 1.0), (None, 1, 2.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    needed = ranges.ranges_needed(df, ["g"])
    assert needed == 300
    placed = ranges.with_range(df, ["g"], "score", needed).where("g = 'hot'").groupBy("range")
    placed = placed.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.countDistinct("score").alias("n"))
    spans = [(r["low"], r["high"], r["n"]) for r in placed.orderBy("range").collect()]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and len(spans) > n // 8
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    pos, neg = s[y == 1], np.sort(s[y == 0])
    wins = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
    assert got["hot"]["auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12) and got["cold"]["auc"] == 0.5
    assert got[None]["auc"] == 1.0
    low = {r["g"]: r["quantile"] for r in quantile(df, ["g"], "score", 0.07).collect()}
    assert low["hot"] == pytest.approx(np.quantile(s, 0.07), abs=1e-12)


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(doc, d, float(v)) for doc, values in enumerate([[1, 5, 2], [3, 5, 4], [8, 5, 0]]) for d, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id int, detector_id int, score double")


def z_of(column):
    column = np.array(column, float)
    return (column - column.mean()) / (column.std() or 1)


def test_scaling_and_combining(scores):
    scaled = ensemble.apply_score_scaler(scores, ensemble.fit_score_scaler(scores, []), [])
    z = np.stack([z_of([1, 3, 8]), z_of([5, 5, 5]), z_of([2, 4, 0])], axis=1)
    assert (z[:, 1] == 0).all()
    got = np.array([[r["0"], r["1"], r["2"]] for r in ensemble.score_matrix(
        scaled.drop("score").withColumnRenamed("z", "score"), [0, 1, 2], ["doc_id"]).orderBy("doc_id").collect()])
    assert np.allclose(got, z)
    for how, call in (("average", np.mean), ("maximisation", np.max), ("median", np.median), ("other", np.median)):
        merged = [r["score"] for r in ensemble.combine(scaled, ["doc_id"], how).orderBy("doc_id").collect()]
        assert np.allclose(merged, call(z, axis=1))
    draws = scaled.sparkSession.createDataFrame(
        [(2, 0, 0), (2, 1, 0), (3, 0, 0), (3, 1, 2), (3, 2, 0)], "draw int, slot int, detector_id int"
    )
    for how, call in (("average", np.mean), ("maximisation", np.max), ("median", np.median)):
        rows = ensemble.sub_ensemble(scaled, ["doc_id"], draws, how).orderBy("draw", "doc_id").collect()
        want = [*call(z[:, [0, 0]], axis=1), *call(z[:, [0, 2, 0]], axis=1)]
        assert np.allclose([r["score"] for r in rows], want)


def test_draws_repeat_and_stay_among_the_detectors(scores):
    draws = ensemble.draw_detectors(scores, [2, 40], 1)
    rows = draws.collect()
    assert sum(r["draw"] == 40 for r in rows) == 40 and {r["detector_id"] for r in rows} == {0, 1, 2}
    assert {tuple(r) for r in rows} == {tuple(r) for r in ensemble.draw_detectors(scores, [2, 40], 1).collect()}


def test_threshold_prediction_and_probability(spark):
    train = spark.createDataFrame([(float(i),) for i in range(11)], "score double")
    limit = ensemble.threshold(train, [], 0.25)
    assert limit.first()["threshold"] == 7.5
    new = spark.createDataFrame([(-3.0,), (7.5,), (8.0,), (20.0,)], "score double")
    labels = {r["score"]: r["label"] for r in ensemble.predict(new, limit, []).collect()}
    assert labels == {-3.0: 0, 7.5: 0, 8.0: 1, 20.0: 1}
    fitted = ensemble.fit_proba(train, [])
    linear = {r["score"]: r["proba"] for r in ensemble.predict_proba(new, fitted, []).collect()}
    assert linear == {-3.0: 0.0, 7.5: 0.75, 8.0: 0.8, 20.0: 1.0}
    unify = {r["score"]: r["proba"] for r in ensemble.predict_proba(new, fitted, [], "unify").collect()}
    assert unify[-3.0] == 0 and unify[8.0] == pytest.approx(math.erf(3 / (math.sqrt(10) * math.sqrt(2))))
    for bad in (0.0, 0.6):
        with pytest.raises(ValueError):
            ensemble.threshold(train, [], bad)


def test_thresholds_by_detector(scores):
    specs = [base("0", contamination=0.5), base("1"), base("2", contamination=0.25)]
    named = scores.withColumn("detector_id", F.col("detector_id").cast("string"))
    limits = {r["detector_id"]: r["threshold"] for r in ensemble.detector_thresholds(named, specs, []).collect()}
    assert limits == {"0": 3.0, "1": 5.0, "2": 3.0}


def test_feature_scaler_and_minmax(spark):
    x = np.array([[1.0, 5, 2], [3, 5, 4], [8, 5, 0]])
    df = spark.createDataFrame([(i, "k", row.tolist()) for i, row in enumerate(x)], "doc_id int, g string, embedding array<float>")
    fitted = scale.fit_scaler(df, ["g"])
    got = np.array([r["embedding"] for r in scale.apply_scaler(df, fitted, ["g"]).orderBy("doc_id").collect()])
    assert np.allclose(got, np.stack([z_of(c) for c in x.T], axis=1))
    whole = scale.apply_scaler(df, scale.fit_scaler(df), []).orderBy("doc_id")
    assert np.allclose([r["embedding"] for r in whole.collect()], got)
    arrays = np.array([r["embedding"] for r in scale.minmax(df, "embedding").orderBy("doc_id").collect()])
    assert np.allclose(arrays, x / 8)
    single = scale.fit_scaler(df.where("doc_id = 0")).first()
    assert list(single["sigma"]) == [0, 0, 0]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["v"] for r in scale.minmax(flat, "v").collect()] == [None, None]


def test_summary(spark):
    rows = [("a", 0.5, 0.1), ("a", 1.0, 0.3), ("b", None, 0.2)]
    out = metrics.summary(spark.createDataFrame(rows, "model string, auc double, ap double"))
    assert {tuple(r) for r in out.collect()} == {("a", 0.75, 0.2), ("b", None, 0.2)}


def test_detectors_a_row_lacks_do_not_count(spark):
    z = spark.createDataFrame([(1, "a", 1.0), (1, "b", 5.0), (2, "b", 7.0)], "doc_id int, detector_id string, z double")
    draws = spark.createDataFrame([(2, 0, "a"), (2, 1, "a"), (3, 0, "a"), (3, 1, "b"), (3, 2, "b")], "draw int, slot int, detector_id string")
    for how, want in (("median", [1.0, 5.0, None, 7.0]), ("average", [1.0, 11 / 3, None, 7.0]), ("maximisation", [1.0, 5.0, None, 7.0])):
        rows = ensemble.sub_ensemble(z, ["doc_id"], draws, how).orderBy("doc_id", "draw").collect()
        assert [r["score"] for r in rows] == want


def test_bounded_groups_are_shuffled_once(spark):
    rng = np.random.default_rng(13)
    rows = [(int(i % 3), int(y), float(s)) for i, (y, s) in enumerate(zip(rng.integers(0, 2, 90), rng.integers(0, 20, 90)))]
    df = spark.createDataFrame(rows, "g int, y int, score double")
    bounded = metrics.ranking_metrics(df, ["g"], ranges=1)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    near = lambda found: sorted((r["g"], round(r["auc"], 9), round(r["ap"], 9)) for r in found.collect())
    assert near(bounded) == near(metrics.ranking_metrics(df, ["g"], ranges=4))
