import random
from itertools import combinations

from pyspark.sql import functions as F

from textanomaly.llm import url_rules

URLS = {
    "http://a.net/x?y#z": ("a.net", "/x", "net/", "block"),
    "http://EXAMPLE.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
    "http://www.example.net/en": ("www.example.net", "/en", "net/", "block"),
    "https://m.example.com/de/5.html": ("m.example.com", "/de/5.html", "example.com/de/", "block"),
    "https://badexample.com/de/5": ("badexample.com", "/de/5", None, "allow"),
    "x://é.org/fr/?q=http://b.net/": ("é.org", "/fr/", "org/fr/", "allow"),
    "http://a.net": ("a.net", "", None, "allow"),
    "http://a.net?x=/": ("a.net", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "no scheme/net/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://org\n/fr/\nx": ("org\n", "/fr/\nx", None, "allow"),
    "http://b.net/" + "p/" * 20_000: ("b.net", "/" + "p/" * 20_000, "net/", "block"),
}


def pages(spark, urls):
    rows = [(i, u, "h", i) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, doc_id long")


def test_hosts_paths_and_fixed_rules(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    urls = [*URLS, "http://a.net/x?y#z"]
    got = url_rules.judge(pages(spark, urls), none).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [URLS[u] for u in urls]
    assert url_rules.judge(pages(spark, []), none).collect() == []


def brute(baskets, min_support, min_confidence):
    """All token combinations of enough support and confidence for the bad label, without redundant ones."""
    held, bad = {}, {}
    for tokens, label in baskets:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                held[part] = held.get(part, 0) + 1
                bad[part] = bad.get(part, 0) + label
    rules = {p: bad[p] / n for p, n in held.items() if bad[p] >= min_support * len(baskets) and bad[p] and bad[p] / n >= min_confidence}
    return {p: c for p, c in rules.items() if not any(set(q) < set(p) and d >= c - 1e-9 for q, d in rules.items())}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(4)
    baskets = []
    for _ in range(300):
        tokens = sorted(rng.sample("abcdefg", rng.randrange(1, 6)))
        chance = 0.9 if {"a", "b"} <= set(tokens) else 0.7 if "g" in tokens else 0.1
        baskets.append((tokens, rng.random() < chance))
    frame = spark.createDataFrame([*baskets, (["a"], None), ([], True)], "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(frame, 0.03, 0.6)
    want = brute(baskets, 0.03, 0.6)
    assert want and {tuple(r.tokens): round(r.confidence, 6) for r in rules.collect()} == {p: round(c, 6) for p, c in want.items()}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(baskets)], "id long, tokens array<string>")
    matched = {r.id: round(r.mined_confidence, 6) for r in url_rules.matching_rules(rows, rules, "id").collect()}
    best = {i: max((round(c, 6) for p, c in want.items() if set(p) <= set(t)), default=None) for i, (t, _) in enumerate(baskets)}
    assert matched == {i: c for i, c in best.items() if c is not None}


def test_labels_block_pages_without_a_rule(spark):
    urls = [f"http://{'spam' if i % 3 == 0 else 'fine'}.example.com/en/{i}" for i in range(90)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(60)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages(spark, urls), labels).select("page_id", "verdict", F.col("rule").isNull().alias("free")).collect()
    assert all(r.free and r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in got)
