import re
from collections import Counter

from textanomaly.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t\n", "a b c a b c", "a a a a a", "é # x\u00a0y | <b>", "x\ny\nx\n x\n\n\nx", "a b c d e\x0bf\x0cg\r\nh",
    "one two three " * 40, " ".join(str(i) for i in range(80)), "w " * 60_000, " ".join(str(i % 997) for i in range(30_000)),
    "A" * 50 + " b",
]


def test_counts_equal_plain_python(spark, documents):
    docs = documents([(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, TEXTS[9], None)])
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[9] if r.doc_id is None else TEXTS[r.doc_id]
        want = counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_hosts_are_shrunk_and_refused(spark, documents):
    good, bad = " ".join(str(i) for i in range(80)), "short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(1000 + i, good, "good") for i in range(100)]
    rows += [(2000 + i, good if i % 2 else bad, f"h{i % 3}") for i in range(30)] + [(3000, good, "one"), (3001, good, None)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(rows)).collect()}
    assert not any(got[i].kept for i in range(100))
    assert all(got[1000 + i].kept for i in range(100)) and got[3000].kept and got[3001].kept
    assert 0 < got[3000].host_rate < 0.5 < got[0].host_rate < 0.9
    same = quality_rules.judge(documents([(1, good, "a"), (2, good, "b")])).collect()
    assert [r.host_rate for r in same] == [0.0, 0.0]
    assert quality_rules.judge(documents([])).collect() == []
