import random
import zlib

import numpy as np

from textanomaly.llm import classifier


def texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        bad = i % 4
        if bad == 0:
            words = [w + "%%%" for w in words]
        elif bad == 1:
            words = [w for w in words[:8] for _ in range(9)]
        rows.append((i, " ".join(words), int(bad > 1)))
    return rows


def test_held_out_accuracy(spark, documents):
    rows = texts(random.Random(2), 600)
    docs = documents([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, rows[2][1]), (2, rows[2][1]), (1002, "wort " * 40_000)])
    labels = spark.createDataFrame([(i, q, 0, "x") for i, _, q in rows] + [(1, None, 0, "y"), (None, 1, 0, "z"), (9999, 0, 0, "")], "doc_id long, quality int, toxic int, text string")
    got = classifier.classify(docs, labels)
    assert got.columns == [*docs.columns, "score", "held_out", "predicted"]
    got = got.collect()
    assert len(got) == 605
    by_id = {r.doc_id: r for r in got}
    for i, r in by_id.items():
        assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(i, q) for i, _, q in rows if by_id[i].held_out]
    assert len(held) > 80 and sum(by_id[i].predicted == q for i, q in held) / len(held) > 0.95
    assert by_id[1000].score == by_id[1001].score and by_id[None].score == by_id[2].score


def test_without_labels_or_documents(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classifier.classify(docs, none).collect()] == [0.5, 0.5]
    assert classifier.classify(documents([]), none).collect() == []


def test_vectors_do_not_depend_on_partitions(spark, documents):
    docs = documents([(i, t) for i, t, _ in texts(random.Random(4), 50)])
    one, many = classifier.word_vectors(docs.coalesce(1)), classifier.word_vectors(docs.repartition(9))
    assert np.array_equal(one, many)


def test_pooling_equals_plain_sums():
    vectors = np.random.default_rng(0).normal(size=(classifier.BUCKETS, classifier.DIM)).astype(np.float32)
    rows = [b"", b"one", b"Two two  two\n%%", b"x " * 150_000, b" "]
    got = classifier.pooled(rows, vectors)
    for row, text in zip(got, rows):
        found, _ = classifier.tokens([text])
        n = len(found) // 2
        assert np.isclose(row[-1], np.log1p(n))
        if n:
            assert np.allclose(row[: classifier.DIM], vectors[found[::2]].astype(float).mean(axis=0), atol=1e-4)
            assert np.allclose(row[classifier.DIM : -1], vectors[found[1::2]].astype(float).mean(axis=0), atol=1e-4)
