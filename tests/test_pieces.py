"""Arrow batches of long texts are worked on a few tokens at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from textanomaly.operators import embed


def test_batches_are_cut_by_their_tokens(monkeypatch):
    monkeypatch.setattr(embed, "PIECE_TOKENS", 5)
    lists = [["a"] * 3, None, ["b"] * 2, ["c"] * 9, [], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    pieces = [piece.to_pylist() for piece in embed.in_pieces(iter([batch, batch.slice(2, 0)]), 1)]
    assert [row for piece in pieces for row in piece] == batch.to_pylist()
    assert [[row["doc_id"] for row in piece] for piece in pieces] == [[0, 1, 2], [3], [4, 5]]


def test_joined_pooling_hands_few_rows_at_a_time_to_python(spark, monkeypatch):
    """Memory of a worker is a batch's, so batches of ten thousand texts made it grow with the rows of a task."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, settle = spark.conf.get(name), embed.settle
    monkeypatch.setattr(embed, "settle", lambda df: seen.append(int(spark.conf.get(name))) or settle(df))
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "b") for i in range(2500)], "doc_id long, text string").coalesce(1)
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [3.0])], "token string, vector array<float>")
    got = {r["doc_id"]: r["embedding"] for r in embed.pool_by_join(docs, vectors, 1, "max").collect()}
    assert got == {i: [3.0] for i in range(2500)}
    assert len(seen) == 2 and max(seen) <= 1000 and spark.conf.get(name) == before


def test_joined_pooling_cuts_texts_once_and_adds_numbers_up_without_objects(spark, monkeypatch):
    """Texts were cut for the sketch and again for the sums, and sums were kept as one object a text."""
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cut.add(1)
        return text.split()

    monkeypatch.setitem(embed.TOKENIZERS, "whitespace", words)
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, "x"), (None, "a"), (3, ""), (4, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([("a", [1.0, -1.0]), ("b", [3.0, 0.5])], "token string, vector array<double>")
    found = embed.pool_by_join(docs, vectors, 2, "sum", "zero", "whitespace", heavy_bytes=16)
    zero = [0.0, 0.0]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, [8.0, -1.0]), (1, [8.0, -1.0]), (2, zero), (None, zero), (3, zero)]))
    assert cut.value == 5
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().toString()
