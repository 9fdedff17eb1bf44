import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textanomaly.llm import fingerprints as fp


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def sketch(text, k=fp.SIZE):
    return sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(text))[:k]


def alike(a, b, k=fp.SIZE):
    union = sorted({*a, *b})
    union = union if max(len(a), len(b)) < k else union[:k]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    result = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        key, text, after = (i, text), text or "", after or ""
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        own, other, following = sketch(text), sketch(changed), sketch(after)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        result[key] = (i, len(text), digest, "".join(own), "".join(other), alike(own, other), alike(own, following))
    return sorted((result[r] for r in rows), key=repr)


def corpus(rng):
    word = lambda: rng.choice(["A", "b", "cé", "🙂", "dd", "e1"]) + str(rng.randrange(9))
    rows = [(rng.randrange(1 << 40), rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randrange(9)))) for _ in range(150)]
    rows += [(i, " ".join(word() for _ in range(rng.randrange(400)))) for i in range(50)]
    return rows + [(90, None), (91, ""), (92, " \n "), (93, "a b c d e"), (94, "a b c d"), (94, "other"), (94, "other"), (None, "n u l l"), (95, "lang é " * 50_000)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("stretch", [fp.STRETCH, 1, 7])
def test_equal_brute_force(spark, documents, monkeypatch, stretch):
    monkeypatch.setattr(fp, "STRETCH", stretch)
    rows = corpus(random.Random(4))
    assert got(fp.edited(documents(rows).repartition(6))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c d e f g h"), (1, "a b c d e f g h")]])
def test_no_rows_and_one_text(spark, documents, rows):
    assert got(fp.edited(documents(rows))) == brute(rows)


def test_parts_merge(spark):
    rng = random.Random(5)
    texts = [(rng.choice(["x", "x", "x", "y", None]), " ".join(str(rng.randrange(30)) for _ in range(rng.randrange(300)))) for _ in range(40)]
    texts.append(("none", " "))
    parts = fp.sketched(spark.createDataFrame(texts, "source string, text string"))
    merged = {r.source: r.sketch for r in fp.merged(parts, ["source"]).collect()}
    for source in ("x", "y", None, "none"):
        union = sorted({h for s, t in texts if s == source for h in sketch(t, 10**9)})
        assert merged[source] == union[: fp.SIZE]
    row = parts.limit(2).agg(F.min_by("sketch", "text").alias("a"), F.max_by("sketch", "text").alias("b")).select(fp.merge(F.col("a"), F.col("b")).alias("m"), "a", "b").first()
    assert row.m == sorted({*row.a, *row.b})[: fp.SIZE]


def test_estimates(spark):
    rng = random.Random(6)
    base = [str(rng.randrange(10**6)) for _ in range(6000)]
    rows = [(" ".join(base[:4000]), " ".join(base[s : s + n])) for s, n in ((0, 4000), (1000, 2000), (2000, 4000), (4500, 1500))]
    rows += [("a b c d e f g", "b c d e f g h"), ("", "x"), ("", "")]
    frame = fp.sketched(fp.sketched(spark.createDataFrame(rows, "a string, b string"), "a", "x"), "b", "y")
    x, y = F.col("x"), F.col("y")
    frame = frame.select("a", "b", fp.resemblance(x, y).alias("r"), fp.containment(y, x).alias("c"), fp.distinct_shingles(x).alias("n"))
    for row in frame.collect():
        a, b = shingles(row.a), shingles(row.b)
        exact = max(len(a), len(b)) < fp.SIZE
        assert abs(row.r - (len(a & b) / len(a | b) if a | b else 1)) <= (0 if exact else 0.15)
        assert abs(row.c - (len(a & b) / len(b) if b else 1)) <= (1e-9 if exact else 0.25)
        assert abs(row.n - len(a)) <= (0 if len(a) < fp.SIZE else 0.3 * len(a))
