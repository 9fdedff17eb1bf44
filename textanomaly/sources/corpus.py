"""Corpus readers, stage reuse and the results sink."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textanomaly.session import settle

# Corpora with a known layout, and the column holding their label.
DATASETS = {
    "dbpedia_14": "label",
    "enron": "label",
    "imdb": "label",
    "newsgroups": "label",
    "reuters": "topics",
    "sms_spam": "label",
    "sst2": "label",
    "web_of_science": "label",
    "ag_news": "label",
}
# The held-out split where it is not called "test".
TEST_SPLITS = {"sst2": "validation"}


def check_dataset(name: str) -> str:
    known = name.lower()
    if known not in DATASETS:
        raise ValueError(f"{name} is not an available dataset: {', '.join(DATASETS)}")
    return known


def label_column(dataset: str) -> str:
    return DATASETS[check_dataset(dataset)]


def test_split(dataset: str) -> str:
    return TEST_SPLITS.get(check_dataset(dataset), "test")


def load_corpus(
    spark: SparkSession, source: str | DataFrame, split: str = "train", dataset: str | None = None,
    file_format: str | None = None, **options,
) -> DataFrame:
    """Rows of a file, folder, table or DataFrame, marked with their ``split``.

    The format follows the file ending (parquet, json, csv) unless it is given;
    a name without a known ending is a catalog table. Records of a CSV file may
    span lines, which keeps such a file in one task: store large corpora as
    parquet, or pass ``multiLine=False``.
    """
    if dataset is not None:
        check_dataset(dataset)
    if isinstance(source, DataFrame):
        return source.withColumn("split", F.lit(split))
    kind = file_format
    if kind is None:
        ending = source.rstrip("/").rsplit(".", 1)[-1].lower()
        kind = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv"}.get(ending)
    if kind is None:
        return spark.table(source).withColumn("split", F.lit(split))
    if kind == "csv":
        options = {"header": True, "multiLine": True, "escape": '"', **options}
    return spark.read.format(kind).options(**options).load(source).withColumn("split", F.lit(split))


def fingerprint(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def stage_path(path: str, settings: dict) -> str:
    return f"{path.rstrip('/')}/{fingerprint(settings)}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``, on any file system Spark reaches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at ``path``."""
    return exists(spark, f"{path}/_SUCCESS")


def cached(spark: SparkSession, build: Callable[[], DataFrame], path: str, settings: dict) -> DataFrame:
    """The stage stored for these settings; built and written first if it is missing.

    Every setting is part of the folder name, so a changed one never reuses an
    older result. A write that did not finish is done again.
    """
    target = stage_path(path, settings)
    if not is_complete(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def file_list(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, modified) of all files at or below ``paths``; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, source: str, files: list[str]) -> DataFrame:
    """Parquet files below ``source``, with the columns its folders are named by."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.read if single else spark.read.option("basePath", source)
    return reader.parquet(*files)


def cached_by_files(
    spark: SparkSession, sources: str | list[str], build: Callable[[DataFrame], DataFrame], path: str, settings: dict,
    read: Callable[[SparkSession, str, list[str]], DataFrame] = read_files,
) -> list[str]:
    """Folders of the stage that ``build`` makes of files, row by row; only files new to the stage are read.

    A file is known by its path, length and time. The rows of new files are one
    commit: they are written first and the list of their files after them, so an
    interrupted commit is done again and never seen. A file that was changed or
    removed starts the stage anew. ``build`` must not look across rows, since it is
    given the new files alone.
    """
    target = stage_path(path, settings)
    key = ["path", "length", "modified"]
    for source in [sources] if isinstance(sources, str) else sources:
        # the driver holds the names of one source's files, as it does to plan a scan of them
        ledger = f"{target}/{fingerprint({'source': source})}/files"
        rows = f"{target}/{fingerprint({'source': source})}/rows"
        now = settle(file_list(spark, source))
        known = settle(spark.read.parquet(ledger)) if is_complete(spark, ledger) else None
        anew = known is not None and not known.join(now, key, "left_anti").isEmpty()
        fresh = now if known is None or anew else now.join(known, key, "left_anti")
        files = sorted((r.path, r.length, str(r.modified)) for r in fresh.collect())
        if not files:
            continue
        commit = fingerprint({"files": files})
        build(read(spark, source, [f[0] for f in files])).write.mode("overwrite").parquet(f"{rows}/{commit}")
        entry = fresh.withColumn("commit", F.lit(commit))
        entry.coalesce(1).write.mode("overwrite" if known is None or anew else "append").parquet(ledger)
    return stage_folders(spark, sources, path, settings)


def stage_folders(spark: SparkSession, sources: str | list[str], path: str, settings: dict) -> list[str]:
    """The folders of all commits of a stage made by ``cached_by_files``."""
    folders = []
    for source in [sources] if isinstance(sources, str) else sources:
        own = f"{stage_path(path, settings)}/{fingerprint({'source': source})}"
        if is_complete(spark, f"{own}/files"):
            commits = spark.read.parquet(f"{own}/files").select("commit").distinct().collect()
            folders += [f"{own}/rows/{r.commit}" for r in commits]
    return sorted(folders)


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Write ``df`` by ``column``; partitions already stored and not in ``df`` stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(column).parquet(path)


def save_results(results: DataFrame, path: str) -> None:
    """Write results by run; runs already stored and not in ``results`` stay."""
    write_partitions(results, path, "run")
