import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from textanomaly.llm import alignment
from textanomaly.llm.alignment import BYTE_LEVEL, FOLDER, PIECES


def brute(rows):
    first, second = Tokenizer.from_file(f"{FOLDER}/{BYTE_LEVEL}"), sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{PIECES}")
    first.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, second.id_to_piece(i)) for i in second.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        if not text or any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, token in side:
                own.append((at, at + len(token), i))
                at += len(token)
            spans.append(own)
        links = [(x, y) for s, e, x in spans[0] for p, q, y in spans[1] if max(s, p) < min(e, q)]
        counts.update(links)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [
            "|".join(",".join(str(i) for _, e, i in side if low < e <= cut) for side in spans) for low, cut in zip([0, *cuts], cuts)
        ]
        found.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, a, b, groups, links in found
    ], counts


def corpus():
    rng = random.Random(2)
    parts = ["the", " cat", "  ", "é", "\n", "naïve", "<|endoftext|>", "</s>", "<0x41>", "日本", "1234567", "\x00", "🙂", "\t", "under_scores", "ﬁ"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (3, rows[3][1]), (None, "no id"), (204, "long " * 300), (205, "x" * 1500 + " y"), (206, "a" + " " * 1200 + "b")]
    return rows


def test_equal_brute_force(spark, documents):
    rows = corpus()
    want, counts = brute(rows)
    got = [tuple(r) for r in alignment.align(documents(rows).repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    pairs = {(r.a, r.b): r.n for r in alignment.pair_counts(documents(rows).repartition(3)).collect()}
    assert pairs == dict(counts)


def test_very_long_text_and_parts_of_counts(monkeypatch):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 3)
    a, b = alignment.load(f"{FOLDER}/{BYTE_LEVEL}", f"{FOLDER}/{PIECES}")
    text = "A very long text, naïve and plain. " * 60_000
    numbers, groups, pairs = alignment.aligned(a, b, [None, text, ""])
    assert numbers["n_links"][1] == numbers["n_a"][1] + numbers["n_b"][1] - numbers["n_groups"][1] and groups[0] == groups[2] == ""
    assert sum(pairs["count_all"].to_pylist()) == numbers["n_links"][1]
    rows = alignment._partial(pairs.select(["pair", "count_all"]).rename_columns(["pair", "n"]))
    assert sum(rows.column(8).to_pylist(), []) == pairs["count_all"].to_pylist()


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_rows_and_no_tokens(spark, documents, rows):
    assert [tuple(r) for r in alignment.align(documents(rows)).collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_both_encoders_agree_on_all_characters():
    tokenizer = Tokenizer.from_file(f"{FOLDER}/{BYTE_LEVEL}")
    tokenizer.encode_special_tokens = True
    a, _ = alignment.load(f"{FOLDER}/{BYTE_LEVEL}", f"{FOLDER}/{PIECES}")
    fast = alignment._by_ranks(tokenizer, a.bytes.to_pylist())
    # every tenth code point above the common ones
    for c in [*range(0x3000), *range(0x3000, 0x110000, 10)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b1{chr(c)} {chr(c)} 2"
            assert fast(text) == tokenizer.encode(text, add_special_tokens=False).ids, hex(c)
