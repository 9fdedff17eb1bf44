import random

import pytest

from textanomaly.llm import mixing


def water(sizes):
    """Targets of sources in order, weights 1, 2, 3 repeating."""
    weights = [float(1 + i % 3) for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        free = total - sum(3 * sizes[i] for i in capped)
        base = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [3.0 * s if i in capped else free * weights[i] / base for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(targets) if i not in capped and t > 3 * sizes[i]}
        if not above:
            return targets
        capped |= above


def rows(rng):
    names = ["src10", "src2", "B", "a", "é", None, "tiny", ""]
    result = []
    for i in range(900):
        source = names[0] if rng.random() < 0.4 else rng.choice(names)
        n = 2 if source == "tiny" else rng.randrange(0, 60) if rng.random() < 0.98 else 900
        result.append((i, " ".join("w" for _ in range(n)), source))
    return result + [(900, None, "a"), (901, "", None), (None, "x y z", "a"), (5, "p q", "a"), (5, "p q", "a")]


def test_targets_and_taken_words(spark, documents):
    data = rows(random.Random(3))
    got = mixing.mix(documents(data)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, water([sizes[s] for s in order])))
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= max(30, 0.15 * targets[s]), s
    again = mixing.mix(documents(data).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    mixed = mixing.mixed_documents(documents(data))
    assert mixed.columns == documents(data).columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_no_words_and_no_rows(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    assert [(r.size, r.taken) for r in mixing.mix(documents([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0), (0, 0)]
    assert mixing.mixed_documents(documents([(1, None, "a")])).collect() == []
