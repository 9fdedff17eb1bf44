"""From raw rows to an embedded corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textanomaly.operators import corpus as ops
from textanomaly.session import settle
from textanomaly.sources.corpus import cached, cached_by_files


def contents(df: DataFrame) -> str:
    """A number for the rows of ``df`` whatever their order: their count and the sum of their hashes."""
    row = F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema])
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{found[0]}-{found[1]}-{df.schema.simpleString()}"


def prepare(
    raw: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    settings: dict | None = None,
    cache: str | None = None,
    label_col: str = "label",
    categories: DataFrame | None = None,
    lowercase: bool = False,
    alnum: bool = False,
    cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Harmonise, clean, drop empty texts, cap every label if ``cap`` is given, then embed what is left.

    ``raw`` has ``doc_id`` and ``split``; labels are capped within a split.
    ``embed`` adds ``embedding``. With a ``cache`` folder the text stage and the
    embedded stage are stored by their settings and by the contents of ``raw`` and
    ``categories``, so another corpus never reads this one's stages; put what
    ``embed`` depends on into ``settings``.
    """
    spark = raw.sparkSession
    text_settings = {**(settings or {}), "label": label_col, "lowercase": lowercase, "alnum": alnum}

    def texts() -> DataFrame:
        df = ops.harmonize(raw, label_col=label_col, keep=["doc_id", "split"])
        if categories is not None:
            df = ops.single_topic(df, categories)
        return ops.clean(df, lowercase=lowercase, alnum=alnum)

    def embedded(df: DataFrame) -> DataFrame:
        kept = ops.non_empty(df)
        return embed(kept if cap is None else ops.cap_per_label(kept, cap, seed, label=["split", "label"]))

    if cache is None:
        # the filter and the cap each read the texts again; cleaning them is the costly part
        return embedded(settle(texts()))
    text_settings |= {"raw": contents(raw), "categories": None if categories is None else contents(categories)}
    stored = cached(spark, texts, f"{cache}/raw", text_settings)
    return cached(spark, lambda: embedded(stored), f"{cache}/processed", {**text_settings, "cap": cap, "seed": seed})


def prepare_files(
    spark: SparkSession,
    source: str,
    embed: Callable[[DataFrame], DataFrame],
    cache: str,
    settings: dict | None = None,
    shape: Callable[[DataFrame], DataFrame] = lambda raw: raw,
    label_col: str = "label",
    categories: DataFrame | None = None,
    lowercase: bool = False,
    alnum: bool = False,
    cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """``prepare`` for a corpus in Parquet files, whose stages go on when files are added.

    A stage is known by its settings and by the path, length and time of its files,
    so a hit reads no row of ``source`` and an added file is the only one computed.
    ``shape`` makes ``doc_id``, ``split``, label and text of the rows read; put what
    it and ``embed`` depend on into ``settings``. ``embed`` works row by row unless
    labels are capped: a cap looks at all rows, so the embedded stage is then made
    again for every new set of files, from the stored texts.
    """
    text_settings = {**(settings or {}), "label": label_col, "lowercase": lowercase, "alnum": alnum}
    text_settings["categories"] = None if categories is None else contents(categories)

    def texts(raw: DataFrame) -> DataFrame:
        df = ops.harmonize(shape(raw), label_col=label_col, keep=["doc_id", "split"])
        if categories is not None:
            df = ops.single_topic(df, categories)
        return ops.clean(df, lowercase=lowercase, alnum=alnum)

    folders = cached_by_files(spark, source, texts, f"{cache}/raw", text_settings)
    if cap is None:
        folders = cached_by_files(spark, folders, lambda df: embed(ops.non_empty(df)), f"{cache}/processed", text_settings)
        return spark.read.parquet(*folders)
    capped = {**text_settings, "folders": folders, "cap": cap, "seed": seed}

    def embedded() -> DataFrame:
        return embed(ops.cap_per_label(ops.non_empty(spark.read.parquet(*folders)), cap, seed, label=["split", "label"]))

    return cached(spark, embedded, f"{cache}/processed", capped)
