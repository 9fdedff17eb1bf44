import random

from textanomaly.llm import decontaminate


def prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(n)]


def plain_similarity(one, other):
    """Written apart from the operator: shared over all counts of five-word strings."""
    size = lambda words: min(5, len(words))
    counted = []
    for words in (one, other):
        n = size(words)
        grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        counted.append({g: grams.count(g) for g in grams})
    every = set(counted[0]) | set(counted[1])
    least = sum(min(c.get(g, 0) for c in counted) for g in every)
    return least / sum(max(c.get(g, 0) for c in counted) for g in every)


def brute(docs, items):
    found = {}
    for doc_id, text in docs:
        words = (text or "").lower().split()
        for item_id, item in items:
            wanted = (item or "").lower().split()
            width = min(len(words), len(wanted))
            if not width or min(5, width) != min(5, len(wanted)):
                continue
            for s in range(len(words) - width + 1):
                window = words[s : s + width]
                if not set(window) & set(wanted):
                    continue
                alike = plain_similarity(window, wanted)
                if alike >= 0.8:
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), alike)
    return found


def test_windows_equal_brute_force(spark, documents):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([1, 3, 5, 12, 30, 30, 60, 100])] + [(8, ""), (9, None), (10, "É " * 20)]
    docs = [(1, None), (2, ""), (3, "word " * 3000)]
    for i in range(60):
        words = prose(rng, rng.randrange(1, 300))
        for _ in range(rng.randrange(3)):
            passage = (items[rng.randrange(8)][1]).split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = rng.choice(["x", "y z"])
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if i % 2 else w for w in passage]
        docs.append((10 + i, " \n".join(words)))
    docs += [docs[-1], (200, "é " * 21)]
    # whole documents that are items less some words at their ends
    for at, (item, front, back) in enumerate([(4, 0, 1), (5, 1, 2), (6, 0, 3), (7, 0, 3), (7, 10, 8), (7, 9, 10), (7, 30, 0), (3, 2, 0), (1, 1, 0)]):
        words = items[item][1].split()
        docs.append((300 + at, " ".join(words[front : len(words) - back])))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_passages(documents(docs), benchmark).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == want
    assert {d for d, _ in want if d >= 300} >= {300, 301, 302, 303, 304}
    held = {r.doc_id for r in got}
    kept = decontaminate.without_passages(documents(docs), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in held)


def test_empty_tables_and_several_passes(spark, documents, monkeypatch):
    benchmark = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(6)], "item_id long, text string")
    docs = documents([(1, "x a b c d e f g 3 y"), (None, "a b c d e f g 5")])
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    got = decontaminate.find_passages(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 5), (1, 3)]
    assert decontaminate.find_passages(documents([]), benchmark).collect() == []
    assert decontaminate.without_passages(docs, benchmark.limit(0)).count() == 2
