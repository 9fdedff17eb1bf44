"""Contaminated splits against a plain loop, and their edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textanomaly.operators import contaminate as tac
from textanomaly.plans.experiments import splits

TREE = {"a": 1, "b": 1, "c": 2, "d": 2, "e": 3}


def corpus(spark, sizes, split=None):
    rows, n = [], 0
    for label, size in sizes.items():
        for _ in range(size):
            rows.append((n, label, split or ("train" if n % 3 else "test")))
            n += 1
    return spark.createDataFrame(rows, "doc_id int, label string, split string"), rows


def hierarchy(spark):
    return spark.createDataFrame(list(TREE.items()), "label string, parent int")


def by_loop(rows, groups, mode, nu, split_size, seed, tree):
    out = set()
    for run, inlier in groups:
        for split in {r[2] for r in rows}:
            key = lambda r: (hashlib.md5(f"{seed}|{run}|{split}|{r[0]}".encode()).hexdigest(), r[0])  # noqa: E731, B023
            here = sorted((r for r in rows if r[2] == split), key=key)
            own = [r for r in here if r[1] == inlier]
            m = min(len(own), split_size)
            c = int(m * nu)
            same = {"independent": False, "contextual": True}[mode]
            others = [r for r in here if r[1] != inlier and (tree[r[1]] == tree[inlier]) == same]
            out |= {(run, inlier, split, r[0], 0) for r in own[: m - c]}
            out |= {(run, inlier, split, r[0], 1) for r in others[: max(c, 1)]}
    return out


@pytest.mark.parametrize("mode, nested", [("independent", True), ("contextual", True), ("independent", False)])
@pytest.mark.parametrize("nu, split_size", [(0.1, 350), (0.1, 20), (0.05, 10), (1.0, 15), (0.0, 10), (0.3, 1)])
def test_equals_a_loop(spark, mode, nu, split_size, nested):
    # one label holds most rows; e is missing from the test split
    df, rows = corpus(spark, {"a": 400, "b": 25, "c": 60, "d": 3})
    rows += [(1000 + i, "e", "train") for i in range(9)]
    df = spark.createDataFrame(rows, df.schema)
    groups = [(run, label) for run in range(2) for label in "abcde"]
    inliers = spark.createDataFrame(groups, "run int, inlier string")
    got = tac.contaminate(df, inliers, mode, nu, split_size, 5, hierarchy(spark) if nested else None)
    want = by_loop(rows, groups, mode, nu, split_size, 5, TREE if nested else {k: k for k in TREE})
    found = [tuple(r) for r in got.select("run", "inlier", "split", "doc_id", "y").collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_layout_of_the_input_does_not_matter(spark):
    df, _ = corpus(spark, {"a": 300, "b": 50, "c": 20})
    inliers = spark.createDataFrame([(0, "a"), (1, "b")], "run int, inlier string")

    def rows(frame):
        return {tuple(r) for r in tac.contaminate(frame, inliers, "contextual", 0.2, 30, 1, hierarchy(spark)).collect()}

    first = rows(df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(df.repartition(9)) == first
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_groups_without_outliers_are_reported(spark):
    df, _ = corpus(spark, {"a": 30, "b": 30, "e": 30}, "train")
    inliers = spark.createDataFrame([(0, "a"), (0, "e")], "run int, inlier string")
    split = tac.contaminate(df, inliers, "contextual", 0.1, 20, 1, hierarchy(spark))
    assert [tuple(r) for r in tac.without_outliers(split).collect()] == [(0, "e", "train", 0)]


def test_labels_outside_the_hierarchy_are_never_outliers(spark):
    df, _ = corpus(spark, {"a": 30, "b": 30, "zz": 500, "c": 10}, "train")
    inliers = spark.createDataFrame([(0, "a")], "run int, inlier string")
    split = tac.contaminate(df, inliers, "independent", 0.5, 20, 1, hierarchy(spark))
    assert {r["label"] for r in split.where("y = 1").collect()} == {"c"}
    assert split.where("y = 1").count() == 10


def test_too_few_outliers_do_not_add_inliers(spark):
    df, _ = corpus(spark, {"c": 40, "d": 2}, "train")
    inliers = spark.createDataFrame([(0, "c")], "run int, inlier string")
    split = tac.contaminate(df, inliers, "contextual", 0.5, 20, 1, hierarchy(spark))
    assert {(r["y"], r["count"]) for r in split.groupBy("y").count().collect()} == {(0, 10), (1, 2)}


def test_draw_inliers(spark):
    eligible = spark.createDataFrame([(x,) for x in "abcdef"], "label string")
    drawn = tac.draw_inliers(eligible, 3, 4, 1)
    assert drawn.distinct().count() == 12
    assert tac.draw_inliers(eligible, 2, 40, 1).count() == 12
    assert drawn.exceptAll(tac.draw_inliers(eligible.repartition(3), 3, 4, 1)).count() == 0


def test_paired_splits(spark):
    df, _ = corpus(spark, {"a": 9}, "train")
    pair = tac.paired_splits(df)
    assert {(r["split"], r["count"]) for r in pair.groupBy("split").count().collect()} == {("train", 9), ("test", 9)}
    assert tac.paired_splits(df, fallback=None).count() == 9
    both = df.unionByName(df.limit(2).withColumn("split", F.lit("validation")))
    assert tac.paired_splits(both, "validation").where("split = 'validation'").count() == 2


def test_wrong_settings(spark):
    df, _ = corpus(spark, {"a": 3})
    inliers = spark.createDataFrame([(0, "a")], "run int, inlier string")
    for bad in ({"mode": "both"}, {"mode": "contextual"}, {"nu": 1.5}, {"split_size": 0}):
        with pytest.raises(ValueError):
            tac.contaminate(df, inliers, **bad)


def test_splits_join_vectors_once_each(spark):
    df, rows = corpus(spark, {"a": 200, "b": 150, "c": 150})
    vectors = df.withColumn("embedding", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")))
    out = splits(vectors, hierarchy(spark), "independent", runs=2, split_size=30, min_size=50, seed=2)
    assert out.select("run", "inlier", "split", "doc_id").distinct().count() == out.count()
    assert out.where("embedding[0] <> doc_id").count() == 0
    counts = {r["count"] for r in out.groupBy("run", "inlier", "split").count().collect()}
    assert counts == {30}
    # ids that begin anew in the test split keep their own vectors
    split = F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")
    anew = vectors.withColumns({"split": split, "doc_id": F.floor(F.col("doc_id") / 2), "embedding": F.array(F.col("doc_id").cast("float"), F.when(split == "test", 1.0).otherwise(0.0).cast("float"))})
    out = splits(anew, hierarchy(spark), "independent", runs=2, split_size=30, min_size=50, seed=2)
    assert out.select("run", "inlier", "split", "doc_id").distinct().count() == out.count()
    assert out.where("embedding[1] <> case when split = 'test' then 1 else 0 end").count() == 0
    assert out.where("floor(embedding[0] / 2) <> doc_id").count() == 0
    with pytest.raises(ValueError, match="repeats"):
        splits(anew.unionByName(anew), hierarchy(spark), "independent", runs=1, split_size=30, min_size=50)
    only = splits(vectors.where("split = 'train'"), hierarchy(spark), runs=1, split_size=30, min_size=50)
    assert {r["split"] for r in only.select("split").distinct().collect()} == {"train", "test"}
