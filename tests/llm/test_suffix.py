import hashlib
import random

import numpy as np

from textanomaly.llm import suffix


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, result = set(), {}
    for doc_id, text in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            part = data[s : s + 100]
            if part in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        result[doc_id, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[i, t]) for i, t in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=repr)


def test_equal_brute_force(spark, documents):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [prose(n) for n in (99, 100, 101, 150, 400)]
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (6, "ab" * 180), (7, "abc" * 150)]
    for i in range(30):
        text = prose(rng.randrange(20, 300)) + rng.choice(shared) + prose(rng.randrange(150)) + rng.choice(shared) + prose(rng.randrange(90))
        rows.append((10 + rng.randrange(300), text))
    base = prose(1200)
    for i in range(12):
        at = rng.randrange(1200)
        rows.append((400 + i, base[:at] + "ZZ" + base[at:]))
    rows += [(500, base), (501, base), (None, base), (20, base), (20, prose(200) + base), (500, base), (600, base[:60_0] * 30)]
    rng.shuffle(rows)
    assert got(suffix.remove_repeats(documents(rows))) == brute(rows)


def test_nothing_repeats_and_no_rows(spark, documents):
    rows = [(1, "a" * 50 + "b" * 60), (2, "short")]
    assert got(suffix.remove_repeats(documents(rows))) == brute(rows)
    assert suffix.remove_repeats(documents([])).collect() == []


def test_periodic_texts_and_runs_that_share_less_than_a_string(spark, documents):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    unit, line = prose(7), prose(99)
    rows = [(1, "x" * 5000), (2, unit * 90), (3, "y" + unit * 40 + "x" * 260), (4, None), (None, unit * 20)]
    rows += [(10 + i, prose(40) + line + prose(40)) for i in range(20)]  # 99 bytes in common: no repeat
    rows += [(50 + i, prose(rng.randrange(90)) + line + "z" * (1 + i % 3) + prose(60)) for i in range(20)]
    long = prose(3000)
    rows += [(80 + i, "".join(c if rng.random() > 0.008 else "#" for c in long)) for i in range(8)]
    assert got(suffix.remove_repeats(documents(rows))) == brute(rows)


def test_every_string_has_one_anchor_and_equal_ones_the_same(spark):
    rng = np.random.default_rng(3)
    for data in (rng.integers(0, 3, 1500, np.uint8), np.zeros(400, np.uint8), np.tile(rng.integers(0, 9, 130, np.uint8), 6)):
        at, hashes, near, far = suffix.anchors(data)
        own = {}
        for a, h, n, f in zip(at.tolist(), hashes.tolist(), near.tolist(), far.tolist()):
            for start in range(a - f, a - n + 1):
                assert start not in own
                own[start] = (a - start, h)
        assert sorted(own) == list(range(len(data) - 99))
        strings = {}
        for start, found in own.items():
            assert strings.setdefault(data[start : start + 100].tobytes(), found) == found


def test_shuffle_files_go_with_the_job_that_made_them(spark, documents):
    """Files that Spark keeps until it collects them made up most of the disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, store = [], suffix.Scratch.store
    before = spark.conf.get(name)
    suffix.Scratch.store = lambda self, *given, **named: seen.append(spark.conf.get(name)) or store(self, *given, **named)
    try:
        rows = [(1, "ab" * 80), (2, "ab" * 90)]
        assert got(suffix.remove_repeats(documents(rows))) == brute(rows)
    finally:
        suffix.Scratch.store = store
    assert set(seen) == {"true"} and spark.conf.get(name) == before
