"""Contaminated splits: an inlier class with a share of rows from other classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.functions.hashing import order_key
from textanomaly.operators.corpus import attach_parent, check_mode, parents_of
from textanomaly.operators.topk import first_k, ranked
from textanomaly.session import attach, settle, small_side


def draw_inliers(eligible: DataFrame, runs: int = 10, k: int = 40, seed: int = 0) -> DataFrame:
    """``min(k, n)`` inlier classes for every run, without replacement."""
    every = eligible.select("label").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    keyed = every.withColumn("__order", order_key(seed, "inlier", F.col("run"), F.col("label")))
    return ranked(keyed, ["run"], "__order", k, ["label"], "__rank").select("run", F.col("label").alias("inlier"))


def with_truth(df: DataFrame) -> DataFrame:
    """``y`` = 0 for the inlier class, 1 for the rest."""
    return df.withColumn("y", F.when(F.col("label") == F.col("inlier"), 0).otherwise(1))


def paired_splits(df: DataFrame, test: str = "test", train: str = "train", fallback: str | None = "train") -> DataFrame:
    """Rows of the train and test splits; an absent test split is replaced by ``fallback``.

    The corpus is read once: one row without the test split in sight decides it.
    """
    wanted = df.where(F.col("split").isin(train, test))
    if fallback is None or not df.where(F.col("split") == test).isEmpty():
        return wanted
    stand_in = df.where(F.col("split") == fallback).withColumn("split", F.lit(test))
    return df.where(F.col("split") == train).unionByName(stand_in)


def contaminate(
    df: DataFrame,
    inliers: DataFrame,
    mode: str = "independent",
    nu: float = 0.1,
    split_size: int = 350,
    seed: int = 0,
    hierarchy: DataFrame | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Every (run, inlier, split) group at once, as keys only.

    ``inliers(run, inlier)`` names the classes; ``df(doc_id, label, split)`` is the
    corpus (``split`` may be missing). A group has ``m = min(rows of the class,
    split_size)``, of which ``c = int(m * nu)`` are left to outliers: the first
    ``max(c, 1)`` rows of another parent (independent) or of a sibling class
    (contextual), in the seeded order of the run and split.

    No outlier list is formed from the whole corpus. Ranked within its own parent
    (or label), a row beyond the largest ``c`` can never be chosen; and among the
    first ``2c`` of what is left at most ``c`` belong to the excluded class, so the
    list each inlier class looks through has ``2c`` rows.
    """
    mode = check_mode(mode, hierarchy)
    if split_size < 1 or not 0 <= nu <= 1:
        raise ValueError("split_size must be positive and nu between 0 and 1")
    source = df if "split" in df.columns else df.withColumn("split", F.lit("train"))
    parents = None if hierarchy is None else small_side(parents_of(hierarchy))

    def parented(rows: DataFrame) -> DataFrame:
        return attach_parent(rows) if parents is None else attach(rows, parents, ["label"], "left")

    keyed = parented(source.select(F.col(id_col).alias("doc_id"), "label", "split"))
    runs = small_side(inliers.select("run", "inlier").distinct())

    counts = settle(source.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))
    splits = counts.agg(F.collect_set("split")).scalar()
    wanted = runs.withColumnRenamed("inlier", "label").withColumn("split", F.explode(splits))
    sizes = wanted.join(counts, ["split", "label"], "left")
    groups = (
        parented(sizes)
        .withColumn("m", F.least(F.coalesce(F.col("n"), F.lit(0)), F.lit(split_size)).cast("int"))
        .withColumn("c", (F.col("m") * F.lit(float(nu))).cast("int"))
        .select("run", F.col("label").alias("inlier"), "split", F.col("parent").alias("p"), "m", "c")
    )
    groups = small_side(groups)

    order = order_key(seed, F.col("run"), F.col("split"), F.col("doc_id"))
    shuffled = (
        keyed.where(F.col("parent").isNotNull())
        .withColumn("run", F.explode(runs.agg(F.collect_set("run")).scalar()))
        .withColumn("h", order)
    )

    own = (
        keyed.join(runs.withColumnRenamed("inlier", "label"), "label")
        .withColumn("h", order)
        .select("run", F.col("label").alias("inlier"), "split", "doc_id", "h")
    )
    inside = first_k(own, ["run", "inlier", "split"], "h", split_size, ["doc_id"])
    inside = attach(inside, groups.drop("p"), ["run", "inlier", "split"]).where(F.col("rank") <= F.col("m") - F.col("c"))

    most = max(int(split_size * nu), 1)
    across = ["run", "split"]
    if mode == "independent":
        nearest = settle(first_k(shuffled, [*across, "parent"], "h", most, ["doc_id"]).drop("rank"))
        pool = first_k(nearest, across, "h", 2 * most, ["doc_id"]).drop("rank")
        found = pool.join(groups, across).where(F.col("parent") != F.col("p"))
    else:
        nearest = settle(first_k(shuffled, [*across, "label"], "h", most, ["doc_id"]).drop("rank"))
        pool = first_k(nearest, [*across, "parent"], "h", 2 * most, ["doc_id"]).drop("rank")
        found = pool.withColumnRenamed("parent", "p").join(groups, [*across, "p"])
        found = found.where(F.col("label") != F.col("inlier"))
    outside = ranked(found, ["run", "inlier", "split"], "h", most, ["doc_id"]).where(
        F.col("rank") <= F.greatest(F.col("c"), F.lit(1))
    )

    columns = ["run", "inlier", "split", "doc_id"]
    chosen = inside.select(*columns, F.col("inlier").alias("label")).unionByName(outside.select(*columns, "label"))
    return with_truth(parented(chosen))


def without_outliers(split: DataFrame) -> DataFrame:
    """(run, inlier, split) groups in which no outlier was found."""
    return split.groupBy("run", "inlier", "split").agg(F.sum("y").alias("outliers")).where("outliers = 0")


def with_vectors(
    split: DataFrame, corpus: DataFrame, id_col: str = "doc_id", vector: str = "embedding", within: tuple[str, ...] = ()
) -> DataFrame:
    """Join the vectors to the chosen keys, late and once.

    The key table is bounded by runs x inliers x split_size; when it proves small
    it is broadcast and the vectors are only scanned. Ids that are unique within
    ``within`` columns only are joined by these too.
    """
    vectors = corpus.select(*within, F.col(id_col).alias("doc_id"), F.col(vector).alias("embedding"))
    return vectors.join(small_side(split), [*within, "doc_id"])
