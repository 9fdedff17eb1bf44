"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact similarity.

For every length that items have, a document's windows of that many words are fingerprinted from running sums of
the bits of their shingles. Fingerprints within the radius of an item's agree with it in one of eight blocks up to
an eighth of the radius, so a table of each block's values finds all of them; the similarity of the shingles'
counts (the sum of the smaller over the sum of the larger counts) is then computed from the words themselves.

A document with fewer words than an item has no window of its length; the whole document is then its one window for
that item, fingerprinted and compared the same way.

A window as similar as asked must hold that share of the item's shingles, so windows with fewer shingles of any
item are left out before they are fingerprinted; this loses none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import Words, mixed, pieces, stored

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
BLOCKS = 8
# Shingles that agree to four fifths leave about 19 of 128 bits different, with a deviation of 4.
RADIUS = 39
# items looked for in one pass; the index of so many takes at most 8 x 2 ** 16 x 1024 / 8 bytes
ITEMS = 1024
ITEM_BYTES = 32 << 20
GATE_BITS = 20
# bits of shingles held at once while windows are fingerprinted (4 bytes each)
WINDOW_BITS = 1 << 24


def shingles(words: list[bytes], size: int = SHINGLE) -> Counter:
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else Counter()


def similarity(one: Counter, other: Counter) -> float:
    both = sum((one & other).values())
    return both / (sum(one.values()) + sum(other.values()) - both)


def _shingle_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the shingle that begins at each word; meaningless where the text ends before its end."""
    hashes = words.hashes()
    total = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        total[: len(hashes) - i] = mixed(total[: len(hashes) - i] + hashes[i:])
    return total


def _bits(hashes: np.ndarray) -> np.ndarray:
    """128 bits a shingle, as 1 and -1."""
    wide = np.column_stack([hashes, mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))])
    return 2 * np.unpackbits(wide.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int32) - 1


def lowered(texts: list[str] | pa.Array) -> list[bytes]:
    """Texts in lower case (of all alphabets) as UTF-8; null is empty."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    return [t or b"" for t in pc.utf8_lower(texts).cast(pa.binary()).to_pylist()]


class Index:
    """Items by length, their fingerprints and, for each block value, the items near it."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, text.split()) for i, text in zip([i for i, _ in items], lowered([t for _, t in items]))]
        self.items = [(i, words) for i, words in items if words]
        self.counts = [shingles(words) for _, words in self.items]
        self.lengths = np.array([len(words) for _, words in self.items])
        words = Words([b" ".join(words) for _, words in self.items], lower=False)
        prints, known = [], []
        for at, length in enumerate(self.lengths.tolist()):
            size = min(SHINGLE, length)
            first = words.first[at]
            hashes = _shingle_hashes(words, size)[first : first + length - size + 1]
            known.append(hashes)
            prints.append(_bits(hashes).sum(axis=0) > 0)
        self.known = {  # shingle sizes below the usual one occur with short items only
            size: np.unique(np.concatenate([k for k, n in zip(known, self.lengths) if min(SHINGLE, n) == size]))
            for size in {min(SHINGLE, n) for n in self.lengths.tolist()}
        }
        self.prints = np.packbits(np.array(prints, bool).reshape(-1, BITS), axis=1)
        blocks = self.prints.view(">u2").astype(np.uint16)
        values = np.arange(1 << 16, dtype=np.uint16)
        near = RADIUS // BLOCKS
        self.near = [
            np.packbits(np.bitwise_count(values[:, None] ^ blocks[None, :, b]) <= near, axis=1) for b in range(BLOCKS)
        ]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with fingerprints within the radius."""
        blocks = np.ascontiguousarray(prints).view(">u2").astype(np.uint16)
        found = self.near[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.near[b][blocks[:, b]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items)))
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        return window[apart <= RADIUS], item[apart <= RADIUS]


def _known(index: Index, hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether an item holds the shingle."""
    gate = np.zeros(1 << GATE_BITS, bool)
    gate[(index.known[size] >> np.uint64(64 - GATE_BITS)).astype(np.int64)] = True
    hit = gate[(hashes >> np.uint64(64 - GATE_BITS)).astype(np.int64)]
    at = np.flatnonzero(hit)
    hit[at] = np.isin(hashes[at], index.known[size])
    return hit


def _windows(index: Index, words: Words, hit: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of the windows of an item's length that hold enough known shingles of ``size`` words."""
    before = np.append(0, np.cumsum(hit))
    ends = words.first[1:][words.rows]  # where each word's text ends
    for length in np.unique(index.lengths).tolist():
        if min(SHINGLE, length) != size or length > len(words):
            continue
        held = length - size + 1
        starts = np.arange(len(words) - length + 1)
        enough = before[held : held + len(starts)] - before[: len(starts)] >= SIMILARITY * held
        starts = starts[enough & (starts + length <= ends[: len(starts)])]
        if len(starts):
            yield length, starts


def _whole_texts(index: Index, words: Words, hit: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of whole texts that are shorter than an item, but not too short to be as similar as asked."""
    before = np.append(0, np.cumsum(hit))
    lengths = index.lengths[np.minimum(SHINGLE, index.lengths) == size]
    for length in np.unique(words.counts).tolist():
        held = length - size + 1
        longer = lengths[lengths > length]
        if held < 1 or not len(longer) or held < SIMILARITY * (longer.min() - size + 1):
            continue
        starts = words.first[:-1][words.counts == length]
        # the shortest longer item has the fewest shingles, and the text must hold that share of them
        starts = starts[before[starts + held] - before[starts] >= SIMILARITY * (longer.min() - size + 1)]
        if len(starts):
            yield length, starts


def _matches(index: Index, texts: list[bytes]) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item) -> best similarity, the window's first word (negated) and its length."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    words = Words(texts, lower=False)
    for size in index.known if len(words) else ():
        hashes = _shingle_hashes(words, size)
        hit = _known(index, hashes, size)
        if not hit.any():
            continue
        for find, shorter in ((_windows, False), (_whole_texts, True)):
            for length, starts in find(index, words, hit, size):
                wanted = index.lengths > length if shorter else index.lengths == length
                _compare(index, words, hashes, length, size, starts, wanted, best)
    return best


def _compare(index, words: Words, hashes, length: int, size: int, starts, wanted, best) -> None:
    """Fingerprint the windows, look for the ``wanted`` items near them and keep each text's best in ``best``."""
    held = length - size + 1
    prints = np.empty((len(starts), BITS // 8), np.uint8)
    step = max(1, WINDOW_BITS // (held * BITS))
    for part in range(0, len(starts), step):
        some = starts[part : part + step]
        bits = _bits(hashes[(some[:, None] + np.arange(held)).ravel()]).reshape(len(some), held, BITS)
        prints[part : part + step] = np.packbits(bits.sum(axis=1) > 0, axis=1)
    for window, item in zip(*(x.tolist() for x in index.candidates(prints))):
        if not wanted[item] or min(SHINGLE, int(index.lengths[item])) != size:
            continue
        start = int(starts[window])
        text = int(np.searchsorted(words.first, start, "right")) - 1
        window_words = [
            bytes(words.data[a:b]) for a, b in zip(words.starts[start : start + length], words.ends[start : start + length])
        ]
        alike = similarity(shingles(window_words), index.counts[item])
        if alike >= SIMILARITY:
            key, found = (text, item), (alike, int(words.first[text]) - start, length)
            best[key] = max(best.get(key, found), found)


def _search(index):
    """``index``: a broadcast Index."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            best = _matches(found, lowered(batch.column(1))) if found.items else {}
            rows = [
                {"doc_id": ids[t], "item_id": found.items[i][0], "similarity": s, "start": -at, "n_words": n}
                for (t, i), (s, at, n) in sorted(best.items())
            ]
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return search


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())]
)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item it holds.

    Words are lower-cased and split at white space; items shorter than a shingle are one shingle. A document shorter
    than an item is compared whole. Null and empty texts hold nothing, items without words match nothing, repeated
    rows are each listed, and of equally similar windows the first is given. Documents are only read; a document with a null id is listed with it. Items are looked for
    in passes of a bounded number and size, so the broadcast index stays small for any benchmark.
    """
    spark = docs.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "benchmark")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for turn in range(2 * passes if passes > 1 else 1):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * passes)) == turn)
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in some.collect()]))
        found = rows.mapInArrow(_search(index), "doc_id long, item_id long, similarity double, start long, n_words long")
        result = found if result is None else result.unionByName(found)
    return result


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark; all rows of a doc_id go together."""
    held = stored(find_passages(docs, benchmark), "benchmark-passages").select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("__held")), "left_anti")
