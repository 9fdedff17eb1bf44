"""Preparing a labelled corpus: columns, topics, text, size of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.functions import text as text_functions
from textanomaly.functions.hashing import order_key
from textanomaly.operators.topk import first_k
from textanomaly.session import attach, broadcast_if_small

# Text columns in the order they are looked for.
TEXT_CANDIDATES = ["content", "input_data", "sentence", "sms", "text"]


def harmonize(
    df: DataFrame,
    text_candidates: list[str] | None = None,
    label_col: str = "label",
    keep: list[str] | None = None,
) -> DataFrame:
    """``label`` and ``text`` under common names; the text column is the first that exists."""
    candidates = text_candidates or TEXT_CANDIDATES
    source = next((c for c in candidates if c in df.columns), None)
    if source is None:
        raise ValueError(f"no text column among {candidates}")
    if label_col not in df.columns:
        raise ValueError(f"no label column {label_col}")
    extra = [F.col(c) for c in (keep or [])]
    return df.select(*extra, F.col(label_col).alias("label"), F.col(source).alias("text"))


def single_topic(df: DataFrame, categories: DataFrame, topics: str = "label") -> DataFrame:
    """Keep rows with exactly one topic found in ``categories(topic, label)``; map it.

    If a topic is listed under several labels, the largest label wins.
    """
    mapping = categories.groupBy("topic").agg(F.max("label").alias("__mapped"))
    one = df.where(F.size(topics) == 1).withColumn("topic", F.element_at(F.col(topics), 1))
    mapped = one.join(broadcast_if_small(mapping), "topic")
    columns = [F.col("__mapped").alias("label") if c == "label" else F.col(c) for c in df.columns]
    if "label" not in df.columns:
        columns.append(F.col("__mapped").alias("label"))
    return mapped.select(*columns)


def clean(df: DataFrame, column: str = "text", lowercase: bool = False, alnum: bool = False) -> DataFrame:
    """Tokenise ``column`` and join the tokens by single spaces."""
    return df.withColumn(column, text_functions.clean_text(F.col(column), lowercase, alnum))


def non_empty(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop null and empty texts."""
    return df.where(F.length(column) > 0)


def cap_per_label(
    df: DataFrame, cap: int = 5000, seed: int = 0, label: str | list[str] = "label", id_col: str = "doc_id"
) -> DataFrame:
    """Uniform sample of ``cap`` rows of every label holding more; others whole."""
    keys = [label] if isinstance(label, str) else label
    keyed = df.withColumn("__order", order_key(seed, F.col(id_col)))
    return first_k(keyed, keys, "__order", cap, [id_col], "__rank").drop("__order", "__rank")


def attach_parent(df: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Parent of every label; without a hierarchy a label is its own parent.

    Labels the hierarchy does not name get a null parent; ``unmapped_labels`` lists them.
    """
    if hierarchy is None:
        return df.withColumn("parent", F.col("label"))
    return attach(df, broadcast_if_small(parents_of(hierarchy)), ["label"], "left")


def parents_of(hierarchy: DataFrame) -> DataFrame:
    """One parent a label; a label listed under several keeps the largest."""
    return hierarchy.groupBy("label").agg(F.max("parent").alias("parent"))


def unmapped_labels(df: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Labels of ``df`` without a parent, with their row counts."""
    return (
        df.join(broadcast_if_small(parents_of(hierarchy).select("label")), "label", "left_anti")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def eligible_inliers(
    df: DataFrame, mode: str = "independent", min_size: int = 350, hierarchy: DataFrame | None = None
) -> DataFrame:
    """Labels large enough to be an inlier class.

    ``contextual`` also asks that the label's parent has two children or more in
    the hierarchy table, whether or not the corpus holds the sibling.
    """
    mode = check_mode(mode, hierarchy)
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    if mode == "independent":
        return counts
    pairs = parents_of(hierarchy)
    shared = pairs.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).where("children >= 2")
    return counts.join(pairs.join(shared, "parent", "left_semi"), "label", "left_semi")


def check_mode(mode: str, hierarchy: DataFrame | None) -> str:
    mode = mode.lower()
    if mode not in ("independent", "contextual"):
        raise ValueError("contamination should be independent or contextual")
    if mode == "contextual" and hierarchy is None:
        raise ValueError("contextual contamination needs a hierarchy table")
    return mode
