import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from textanomaly.llm import phrases


def brute(rows, least, longer, first):
    """rows: (lang, text)."""
    grams, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    grams[lang][tuple(words[i : i + m])] += 1
    result = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= longer * a and inside(q) for q, b in candidates.items()):
                continue
            cuts = [(phrases.SCALE * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(result)


def corpus(rng):
    vocabulary = ["a", "B", "cé", "dd", "e-f", " g", "h i"]
    rows = []
    for _ in range(120):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\n", "\r", "\x0b"]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows + [("en", None), ("en", ""), (None, " . "), ("fr", "x"), ("en", "A b cé " * 3000), ("en", "A b cé " * 3000)]


@pytest.mark.parametrize("shard_bytes, first", [(phrases.SHARD_BYTES, 2000), (300, 7)])
def test_equal_brute_force(spark, monkeypatch, shard_bytes, first):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)  # seen by workers forked later only; partitions cut shards too
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame([(i, t, l, 1, "x") for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, a int, word string")
    got = phrases.phrases(docs.repartition(9), 5, 80, first).drop("most_left", "most_right").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5, 80, first)


def test_extensions_on_both_sides(spark):
    docs = spark.createDataFrame([("x a b y",)] * 3 + [("x a b z",)] * 2 + [("w a b",)] * 9, "text string").selectExpr("text", "'en' as lang")
    got = {r.phrase: (r.most_left, r.most_right) for r in phrases.phrases(docs, 2, 100, 50).collect()}
    assert got["a b"] == (9, 3) and got["x a b"] == (None, 3) and got["x a b y"] == (None, None)


def test_no_rows(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_intervals_hold_the_occurrences(seed):
    rng = np.random.default_rng(seed)
    sequence = np.append(0, rng.integers(0, 4, 300))
    sequence = np.append(sequence, 0)
    forward, backward = phrases.Transform(sequence, 4), phrases.Transform(sequence[::-1], 4)
    grams, numbers = phrases.single_words(sequence)
    spelt = [(int(w),) for w in numbers]
    for size in (2, 3, 4):
        left = bool(rng.integers(2))
        grams = phrases.extended(forward if left else backward, grams, left)
        spelt = [spelt[p] + spelt[s][-1:] for p, s in zip(grams.prefix, grams.suffix)]
        windows = Counter(tuple(map(int, sequence[i : i + size])) for i in range(len(sequence) - size + 1))
        assert dict(zip(spelt, grams.count.tolist())) == {w: c for w, c in windows.items() if 0 not in w}


def test_memory_of_a_shard_where_all_pairs_are_frequent(monkeypatch):
    """Shards of 8 MB took 300 MB in a Python worker once most of their pairs were frequent, as on large corpora."""
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i:05}" for i in range(20_000)])
    texts = [" ".join(rng.choice(vocabulary, 1000)) for _ in range(1200)]  # 8.4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    shards = [pa.table(shard) for shard in pa.Table.from_batches(phrases._sharded(iter([batch]))).to_batches(1)]
    assert sum(sum(shard["counts"][0].as_py()) for shard in shards) == 1_200_000
    largest = max(shards, key=lambda shard: len(shard["sequence"][0].as_py()))
    n = len(largest["words"][0])
    words = pa.table([pa.array(range(n)), pa.array(range(n))], ["place", "word_id"])
    tracemalloc.start()
    try:
        paired = phrases._pairs((pa.scalar(1),), largest, words)
        found = phrases._longer((pa.scalar(1),), paired, pa.table([paired["pairs"].combine_chunks().values], ["pair"]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 2
    assert peak < 100 << 20, peak
