import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textanomaly.llm import simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_bit_planes_find_what_pairs_do():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(12)})
    buckets = np.sort(np.array([rng.randrange(3) for _ in prints]))
    for radius in (0, 1, 3, 6):
        links = simhash.bucket_links(np.array(prints, np.uint64).view(np.int64), buckets, radius)
        joined = {p: p for p in prints}

        def find(p):
            while joined[p] != p:
                p = joined[p]
            return p

        for a, b in links:
            a, b = a % 2**64, b % 2**64
            assert (a ^ b).bit_count() <= radius
            joined[find(a)] = find(b)
        for i, a in enumerate(prints):
            for j in range(i):
                if buckets[i] == buckets[j] and (a ^ prints[j]).bit_count() <= radius:
                    assert find(a) == find(prints[j])


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n))


def test_components_equal_brute_force(spark, documents):
    rng = random.Random(5)
    texts = [words(rng, n) for n in (1, 2, 3, 4, 300, 400, 500)] + ["", None, " \n", "x" * 200_000, "A b C d"]
    texts += [texts[4], texts[5] + " a", texts[6].replace("a", "b", 1), "a B c D", texts[4]]
    for _ in range(60):
        parts = texts[6].split(" ")
        parts[rng.randrange(len(parts))] = "zz"
        texts.append(" ".join(parts))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents([(100 - i, texts[i]) for i in order])
    got = {r.doc_id: (r.hex, r.component_id) for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits("fp")).collect()}
    prints = [plain_print(t) for t in texts]
    roots = plain_components(prints)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, 999), 100 - i)
    assert got == {100 - i: (f"{prints[i]:016x}", least[roots[i]]) for i in range(len(texts))}
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert kept == sorted(set(least.values()))


def test_hot_buckets_are_split(spark):
    rng = random.Random(9)
    prints = sorted({(1 << 60) | sum(1 << rng.randrange(12) for _ in range(rng.randrange(4))) for _ in range(300)})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = simhash.components(simhash.fingerprint_links(nodes, chunk=20)).collect()
    roots = plain_components(prints)
    assert {r.node: r.root for r in found} == {p: prints[r] for p, r in zip(prints, roots) if prints[r] != p}


def test_nulls_repeats_and_no_rows(spark, documents):
    docs = documents([(None, "one text here"), (None, "one text here"), (3, "another text there"), (3, "another text there"), (4, None), (None, "")])
    rows = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert rows == [(0, 0), (0, 0), (0, 4), (3, 3), (3, 3), (4, 4)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "one text here"), (3, "another text there"), (4, "")]
    assert simhash.near_duplicates(documents([])).collect() == []


def test_unlike_texts_of_one_id_stay(spark, documents):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["c"]), (3, text["a"]), (1, text["a"]), (None, text["b"]), (4, None), (4, "")]
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(documents(rows).repartition(5)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    assert got == [(1, text["a"]), (1, text["b"]), (2, text["c"]), (4, "")]
