"""Stages that follow their source's files."""

import os

import pytest
from pyspark.sql import functions as F

from textanomaly.plans.prepare import prepare_files
from textanomaly.sources.corpus import cached_by_files


def put(spark, source, name, rows):
    spark.createDataFrame(rows, "doc_id long, label string, text string").coalesce(1).write.mode("overwrite").parquet(f"{source}/split={name}")


class Watched:
    def __init__(self):
        self.read = []

    def __call__(self, df):
        self.read.append(sorted({f.split("split=")[1].split("/")[0] for f in df.inputFiles()}))
        return df.withColumn("size", F.length("text"))


def rows_of(spark, folders):
    return sorted((r.doc_id, r.split, r.size) for r in spark.read.parquet(*folders).collect())


def test_only_new_files_are_read(spark, tmp_path):
    source, stage, build = str(tmp_path / "raw"), str(tmp_path / "stage"), Watched()
    put(spark, source, "a", [(1, "x", "one"), (2, "x", None)])
    once = lambda **more: rows_of(spark, cached_by_files(spark, source, build, stage, {"v": 1, **more}))
    assert once() == [(1, "a", 3), (2, "a", None)]
    assert once() == [(1, "a", 3), (2, "a", None)]
    assert build.read == [["a"]]
    put(spark, source, "b", [(3, "y", "three"), (3, "y", "three")])
    assert once() == [(1, "a", 3), (2, "a", None), (3, "b", 5), (3, "b", 5)]
    assert build.read == [["a"], ["b"]]
    assert len(once(v=2)) == 4 and build.read[2] == ["a", "b"]


def test_a_changed_file_starts_anew(spark, tmp_path):
    source, stage, build = str(tmp_path / "raw"), str(tmp_path / "stage"), Watched()
    put(spark, source, "a", [(1, "x", "one")])
    put(spark, source, "b", [(2, "x", "two")])
    cached_by_files(spark, source, build, stage, {})
    put(spark, source, "b", [(2, "x", "three")])
    assert rows_of(spark, cached_by_files(spark, source, build, stage, {})) == [(1, "a", 3), (2, "b", 5)]
    assert build.read == [["a", "b"], ["a", "b"]]


def test_a_stopped_commit_is_not_seen_and_done_again(spark, tmp_path):
    source, stage, build = str(tmp_path / "raw"), str(tmp_path / "stage"), Watched()
    put(spark, source, "a", [(1, "x", "one")])
    cached_by_files(spark, source, build, stage, {})
    put(spark, source, "b", [(2, "x", "two")])

    def broken(df):
        return build(df).withColumn("size", F.raise_error(F.lit("stopped")).cast("int"))

    with pytest.raises(Exception, match="stopped"):
        cached_by_files(spark, source, broken, stage, {})
    (kept,) = [f for f in os.listdir(stage)]
    (own,) = os.listdir(f"{stage}/{kept}")
    assert spark.read.parquet(f"{stage}/{kept}/{own}/files").count() == 1
    assert rows_of(spark, cached_by_files(spark, source, build, stage, {})) == [(1, "a", 3), (2, "b", 3)]


@pytest.mark.parametrize("cap", [None, 2])
def test_prepared_by_files_goes_on(spark, tmp_path, cap):
    source, cache, seen = str(tmp_path / "raw"), str(tmp_path / "cache"), []

    def embed(df):
        seen.append(df.count())
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    put(spark, source, "train", [(1, "x", "One, two"), (2, "x", ""), (3, "x", None), (4, "y", "é")])
    call = lambda: sorted((r.split, r.doc_id, r.embedding[0]) for r in prepare_files(spark, source, embed, cache, cap=cap).collect())
    first = call()
    assert [r[1] for r in first] == [1, 4] and call() == first and seen == [2]
    put(spark, source, "test", [(1, "x", "three")])
    assert call() == [("test", 1, 5.0), *first]
    assert seen == ([2, 1] if cap is None else [2, 3])
