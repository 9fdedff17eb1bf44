"""All stages in a chain on small tables, each held against a plain version on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import xxhash

KIND = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "score string, predicted int, size long, fp string, component_id int, taken long, target double, found int"
)
CARD = "4539578763621486"


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(n))


def write(spark, folder, rows, labels, items):
    full = [(i, t, "en", s, None if t is None else len(t), "own", 7, 1, "x", 2, 3, 0.5, 4) for i, t, s in rows]
    spark.createDataFrame(full, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Lists of rows linked by three bits or fewer, through any number of links."""
    prints = [fingerprint(r.text) for r in rows]
    left, found = set(range(len(rows))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            at = todo.pop()
            group.append(rows[at])
            near = {o for o in left if (prints[at] ^ prints[o]).bit_count() <= 3}
            left -= near
            todo += near
        found.append(group)
    return found


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """(name, input rows, output rows) of every stage."""
    folder = str(tmp_path_factory.mktemp("tables") / "sf")
    rng = random.Random(2)
    item = prose(rng, 60)
    rows = [(i, prose(rng, 80), "abc"[i % 3]) for i in range(40)]
    junk = [(100 + i, "$$ ## buy buy buy " * 12 + str(i), "a") for i in range(20)]
    rows += [(50, rows[3][1], "b"), (51, rows[3][1].upper(), None), rows[4], (52, prose(rng, 30) + " " + item, "c")]
    rows += [(53, " ".join(item.split()[:-2]), "a"), (54, None, "a"), (55, "", "b"), (None, prose(rng, 50), "a")]
    rows += [(56, f"{prose(rng, 40)} card {CARD} end", "b"), (57, f"{prose(rng, 40)} {CARD}", "c"), (58, prose(rng, 20_000), "a")]
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(15)] + [(None, 1, 0), (5, None, None)]
    write(spark, folder, rows + junk, labels, [(1, item), (2, None), (3, "")])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == docs.columns
        seen[name] = docs.collect(), after.collect()
        docs = after
    return seen


def test_quality_keeps_clean_documents_whole(chain):
    before, after = chain["quality"]
    assert not Counter(after) - Counter(before)
    kept = {r.doc_id for r in after}
    assert kept >= set(range(40)) | {50, 52, 53, 56, 57, 58, None} and not kept & set(range(100, 120))


def test_one_row_of_each_group_stays(chain):
    before, after = chain["near_duplicates"]
    assert not Counter(after) - Counter(before)
    every = groups(before)
    least = [min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in every]
    assert Counter(r.doc_id for r in after) == Counter(least)


def test_passages_go_and_others_stay(chain):
    before, after = chain["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {52, 53}
    assert Counter(after) == Counter(r for r in before if r.doc_id not in (52, 53))


def test_cards_are_replaced_alike(chain):
    before, after = chain["private_values"]
    assert len(before) == len(after) and not any(CARD in (r.text or "") for r in after)
    texts = {r.doc_id: r.text for r in after}
    number = re.search(r"card (\d{16}) end", texts[56]).group(1)
    assert texts[57].endswith(number)
    assert all(texts[r.doc_id] == r.text for r in before if CARD not in (r.text or ""))


def test_mix_takes_rows_near_their_targets(chain):
    before, after = chain["mixture"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert max(Counter(after).values()) <= 3 and all(words(r.text) for r in after)
    taken = Counter()
    for r in after:
        taken[r.source] += words(r.text)
    held = Counter()
    for r in before:
        held[r.source] += words(r.text)
    assert all(taken[s] <= 3 * held[s] + max(words(r.text) for r in before) for s in held)


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path / "sf"), [], [], [])
    got = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert got.collect() == [] and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
