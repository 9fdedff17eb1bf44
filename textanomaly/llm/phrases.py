"""Phrases that occur together more often than their parts, counted with FM-indexes over word ids.

Every task cuts its texts into shards of one language. A shard's words become ids, and its sequence of ids gets two
Burrows-Wheeler transforms, one of the sequence and one of its reverse. An n-gram is an interval in both. Extending all
intervals by a word to the left reads the first transform, to the right the second, and keeps the other in step. An
interval of the first lies in that of the n-gram's first words, one of the second in that of its last words, so every
n-gram knows the two shorter ones it extends to the left and to the right. Counts are summed over the shards:

1. words; those below the least count break the sequence, as no phrase that holds one can reach it,
2. pairs of the words left,
3. n-grams of three and four words whose pairs all reach the least count.

Transforms are sorted by as many words as the longest n-gram has, which is exact for n-grams of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.llm.common import LOWER, Scratch, ranked, text_bytes
from textanomaly.session import broadcast_if_small, shuffles_removed, small_batches

LEAST, LONGER, FIRST = 30, 80, 2000
LONGEST = 4  # words
ID_BITS = 31  # of a word's id
# of text; a longer text is a shard of its own. Work on a shard takes up to 40 times its text where all its pairs are frequent
SHARD_BYTES = 2 << 20
# a shard is one row, so that Parquet's writers and readers would hold all shards of a task at once
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}
SCALE = 2_000_000
UNDEFINED = "und"
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def coded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1 in order of appearance with 0 between pieces, at the start and the end; and the words."""
    data = LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(1, np.int32), pa.array([], pa.string())
    breaks = np.flatnonzero(kind == 2)
    piece = np.searchsorted(breaks, starts)
    offsets = np.append(0, np.cumsum(ends - starts))
    values = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))
    found = values.dictionary_encode()
    opens = np.append(True, piece[1:] != piece[:-1])
    sequence = np.zeros(len(starts) + int(opens.sum()) + 1, np.int32)
    sequence[np.arange(len(starts)) + np.cumsum(opens)] = found.indices.to_numpy() + 1
    return sequence, found.dictionary


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's texts by language: number, words with their counts, sequence of word numbers."""
    number = TaskContext.get().partitionId() << 32
    texts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal number
        sequence, words = coded(texts.pop(lang))
        held.pop(lang)
        counts = np.bincount(sequence, minlength=len(words) + 1)[1:]
        number += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([lang]),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                *_lists(counts), pa.array([sequence.astype("<i4").tobytes()]),
            ],
            ["shard", "lang", "words", "counts", "sequence"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch)):
            texts.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text) + 1
            if held[lang] >= SHARD_BYTES:
                yield shard(lang)
    for lang in list(texts):
        yield shard(lang)


def reduced(sequence: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The sequence of the places kept, with one 0 wherever something is left out, without words that stand alone."""
    keep = keep & (sequence > 0)
    beside = np.zeros(len(keep), bool)
    beside[:-1] |= keep[1:]
    beside[1:] |= keep[:-1]
    keep &= beside
    at = np.flatnonzero(keep)
    opens = np.append(True, np.diff(at) > 1)[: len(at)]
    out = np.zeros(len(at) + int(opens.sum()) + 1, np.int64)
    out[np.arange(len(at)) + np.cumsum(opens)] = sequence[at]
    return out


class Transform:
    """A Burrows-Wheeler transform of a sequence that starts and ends with 0, sorted by its first words."""

    def __init__(self, sequence: np.ndarray, depth: int):
        rank, width = sequence.astype(np.int64), 1
        while width < depth:
            rank = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(rank, kind="stable")
            ordered = rank[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            width *= 2
        self.symbols = sequence[order - 1].astype(np.int64)
        # row of a symbol's rotation: rows by symbol, then in order
        self.last_to_first = np.empty(len(order), np.int64)
        self.last_to_first[np.argsort(self.symbols, kind="stable")] = np.arange(len(order))


class Grams:
    """All n-grams of one length: intervals in both transforms, and the n-grams of their first and last words."""

    def __init__(self, low: np.ndarray, count: np.ndarray, back: np.ndarray):
        self.low, self.count, self.back = low, count, back
        self.prefix = self.suffix = self.first = self.last = np.zeros(0, np.int64)

    def kept(self, which: np.ndarray) -> Grams:
        out = Grams(self.low[which], self.count[which], self.back[which])
        for name in ("prefix", "suffix", "first", "last"):
            if len(getattr(self, name)):
                setattr(out, name, getattr(self, name)[which])
        return out


def single_words(sequence: np.ndarray) -> tuple[Grams, np.ndarray]:
    """Words as n-grams, and their numbers."""
    counts = np.bincount(sequence)
    words = np.flatnonzero(counts[1:]) + 1
    low = np.cumsum(counts)[words - 1]
    return Grams(low, counts[words], low), words


def _within(lows: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which interval holds a row; -1: none. Intervals don't overlap."""
    if not len(lows):
        return np.full(len(rows), -1, np.int64)
    order = np.argsort(lows)
    at = np.searchsorted(lows[order], rows, side="right") - 1
    own = order[np.maximum(at, 0)]
    return np.where((at >= 0) & (rows < lows[own] + counts[own]), own, -1)


def extended(transform: Transform, grams: Grams, left: bool = True) -> Grams:
    """All n-grams one word longer whose first words and last words are both among ``grams``.

    ``transform`` is of the sequence to extend to the left, of its reverse to extend to the right.
    """
    low, other = (grams.low, grams.back) if left else (grams.back, grams.low)
    starts = np.cumsum(grams.count) - grams.count
    own = np.repeat(np.arange(len(grams.count)), grams.count)
    rows = np.arange(len(own)) - starts[own] + low[own]
    symbols = transform.symbols[rows]
    key = own * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    count = np.diff(np.append(heads, len(key)).astype(np.int64))
    order = order[heads]
    parent, top, word = own[order], rows[order], symbols[order] > 0
    smaller = heads - starts[parent]
    del own, rows, symbols, key, order, heads  # as long as the sequence
    count, parent, top, smaller = count[word], parent[word], top[word], smaller[word]
    reached, shifted = transform.last_to_first[top], other[parent] + smaller
    within = _within(low, grams.count, reached)
    out = Grams(reached, count, shifted) if left else Grams(shifted, count, reached)
    out.prefix, out.suffix = (within, parent) if left else (parent, within)
    return out.kept(within >= 0)


SHARDS = "shard long, lang string, words array<string>, counts array<long>, sequence binary"
PAIRS = "shard long, vocabulary array<long>, sequence binary, pairs array<long>, counts array<long>"
LONG = "size int, first array<long>, last array<long>, counts array<long>"


def _lists(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a], pa.list_(pa.int64())) for a in arrays]


def _pairs(key, shard: pa.Table, words: pa.Table) -> pa.Table:
    """Pairs of frequent words of a shard, by the words' ids, and the shard's sequence of those words."""
    sequence = np.frombuffer(shard["sequence"][0].as_py(), "<i4")
    known = np.full(int(sequence.max(initial=0)) + 1, -1, np.int64)
    known[np.asarray(words["place"]) + 1] = np.asarray(words["word_id"])
    sequence = reduced(sequence, known[sequence] >= 0)
    inside = sequence > 0
    vocabulary, local = np.unique(known[sequence[inside]], return_inverse=True)
    sequence[inside] = local + 1
    grams, numbers = single_words(sequence)
    pairs = extended(Transform(sequence, 2), grams)
    ids = vocabulary[numbers[pairs.prefix] - 1] << ID_BITS | vocabulary[numbers[pairs.suffix] - 1]
    return pa.table(
        [
            pa.array([key[0].as_py()], pa.int64()), *_lists(vocabulary), pa.array([sequence.astype("<i4").tobytes()]),
            *_lists(ids, pairs.count),
        ],
        ["shard", "vocabulary", "sequence", "pairs", "counts"],
    )


def _longer(key, shard: pa.Table, pairs: pa.Table) -> pa.Table:
    """N-grams of three and more words of a shard whose pairs are all frequent, by their first and last pair."""
    names = ["size", "first", "last", "counts"]
    if not shard.num_rows or not pairs.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.list_(pa.int64())] * 3)], names)
    sequence = np.frombuffer(shard["sequence"][0].as_py(), "<i4").astype(np.int64)
    vocabulary = shard["vocabulary"].combine_chunks().values.to_numpy()
    base = len(vocabulary) + 1
    ids = np.sort(np.asarray(pairs["pair"]))
    first, last = (np.searchsorted(vocabulary, part) + 1 for part in (ids >> ID_BITS, ids & ((1 << ID_BITS) - 1)))
    keys = first * base + last  # in the same order
    good = np.isin(sequence[:-1] * base + sequence[1:], keys)
    keep = np.zeros(len(sequence), bool)
    keep[:-1] |= good
    keep[1:] |= good
    sequence = reduced(sequence, keep)
    forward, backward = Transform(sequence, LONGEST), Transform(sequence[::-1], LONGEST)
    grams, numbers = single_words(sequence)
    grams = extended(forward, grams)
    own = numbers[grams.prefix] * base + numbers[grams.suffix]
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    frequent = keys[at] == own
    grams = grams.kept(frequent)
    grams.first = grams.last = ids[at[frequent]]
    rows = []
    for size in range(3, LONGEST + 1):
        left = size % 2 == 0
        shorter, grams = grams, extended(forward if left else backward, grams, left)
        grams.first, grams.last = shorter.first[grams.prefix], shorter.last[grams.suffix]
        rows.append(pa.table([pa.array([size], pa.int32()), *_lists(grams.first, grams.last, grams.count)], names))
    return pa.concat_tables(rows)


def _words(pair: Column) -> Column:
    return F.array(F.shiftright(pair, ID_BITS), pair.bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """N-grams of 1 to 4 words that occur ``least`` times: (lang, words by id, ``a``); the words by id; the number of
    all word occurrences by language."""
    with shuffles_removed(docs.sparkSession):
        return _counted(docs, least, Scratch(docs, "phrases"))


def _counted(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    with small_batches(docs.sparkSession):
        shards = scratch.store(rows.mapInArrow(_sharded, SHARDS), "shards", options=LARGE_ROWS)
    inside = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    inside = inside.select("shard", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    summed = inside.groupBy("lang", "word").agg(F.sum("count").alias("a"))
    totals = scratch.store(
        shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n"))
        .groupBy("lang").agg(F.sum("n").alias("n")),
        "totals",
    )
    words = ranked(summed.where(F.col("a") >= least), [F.col("lang"), F.col("word")], "word_id")
    # a pair of ids is one number
    words = words.withColumn("word_id", F.when(F.col("word_id") < 1 << ID_BITS, F.col("word_id")).otherwise(F.raise_error(F.lit("too many words"))))
    words = scratch.store(words, "words")
    places = inside.select("shard", "lang", "place", "word").join(
        broadcast_if_small(words.select("lang", "word", "word_id")), ["lang", "word"]
    )
    # both sides are dealt by shard, a bounded part of a task's texts
    paired = shards.select("shard", "sequence").groupBy("shard").cogroup(
        places.select(F.col("shard").alias("own"), "place", "word_id").groupBy("own")
    ).applyInArrow(_pairs, PAIRS)
    found = scratch.store(paired, "pairs", options=LARGE_ROWS)
    scratch.drop("shards")
    # a shard has a pair once, so that adding up and telling the shards takes one shuffle and no join
    pairs = found.select(F.col("shard").alias("own"), F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    pairs = pairs.select("own", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("count"))
    pairs = pairs.select("own", "pair", F.sum("count").over(Window.partitionBy("pair")).alias("a")).where(F.col("a") >= least)
    frequent = scratch.store(pairs, "frequent")
    longer = found.select("shard", "vocabulary", "sequence").groupBy("shard").cogroup(
        frequent.select("own", "pair").groupBy("own")
    ).applyInArrow(_longer, LONG)
    longer = scratch.store(longer, "longer", options=LARGE_ROWS)
    scratch.drop("pairs")
    longer = longer.select("size", F.explode(F.arrays_zip("first", "last", "counts")).alias("g"))
    longer = longer.groupBy("size", "g.first", "g.last").agg(F.sum("g.counts").alias("a")).where(F.col("a") >= least)
    first, last = _words(F.col("first")), _words(F.col("last"))
    # three words: the pairs share the middle one
    spelt = F.concat(first, F.when(F.col("size") == 3, F.slice(last, 2, 1)).otherwise(last))
    two = frequent.select("pair", "a").distinct().select(_words(F.col("pair")).alias("words"), "a")
    more = two.unionByName(longer.select(spelt.alias("words"), "a")).withColumn("word_id", F.col("words")[0])
    more = more.join(words.select("lang", "word_id"), "word_id").select("lang", "words", "a")
    one = words.select("lang", F.array("word_id").alias("words"), "a")
    grams = scratch.store(one.unionByName(more), "grams")
    scratch.drop("frequent", "longer")
    return grams, words, totals


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def phrases(docs: DataFrame, least: int = LEAST, longer: int = LONGER, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, most_left and most_right of each language's first phrases.

    Words are lower-cased (A-Z), separated by blanks and tabs within pieces; pieces end at ``. , ; : ! ?`` and line
    ends. Null and empty texts have no words, a null language is ``und``. Repeated rows count again; very long texts are
    taken whole. A phrase has 2 to 4 words and occurs ``least`` times; it is cut where 2,000,000 a / (l + r) is lowest,
    ties to the shortest first part. It is left out if a longer phrase around it has ``longer`` % of its occurrences.
    most_left and most_right are the occurrences of the most frequent phrase one word longer on that side (null: below
    ``least``, or four words already). Without rows the result is empty.
    """
    grams, words, totals = counted(docs, least)
    size = F.size("words")
    phrase = grams.where(size > 1)
    # a longer phrase holds one that is one word longer, which occurs at least as often
    around = phrase.where(size > 2).select(
        "lang", "a", F.explode(F.array(
            F.struct(F.slice("words", F.lit(1), size - 1).alias("words"), F.lit(False).alias("left")),
            F.struct(F.slice("words", F.lit(2), size - 1).alias("words"), F.lit(True).alias("left")),
        )).alias("x"),
    )
    around = around.groupBy("lang", "x.words").agg(
        F.max(F.when(F.col("x.left"), F.col("a"))).alias("most_left"), F.max(F.when(~F.col("x.left"), F.col("a"))).alias("most_right")
    )
    most = F.coalesce(F.greatest("most_left", "most_right"), F.lit(0))
    left = phrase.join(around, ["lang", "words"], "left").where(_exact(most) * 100 < _exact(F.col("a")) * longer)
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(grams.select("lang", F.col("words").alias(part), F.col("a").alias(name)), ["lang", part])
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words").agg(lowest, *(F.first(c).alias(c) for c in ("a", "most_left", "most_right")))
    spelt = scored.select("lang", "words", F.posexplode("words").alias("at", "word_id")).join(words.select("word_id", "word"), "word_id")
    spelt = spelt.groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    rows = scored.join(spelt, ["lang", "words"]).select(
        "lang", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score", "most_left", "most_right"
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of many small groups, so that no task ranks a whole language
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__group").orderBy(*order)))
    rows = rows.where(F.col("__rank") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    rows = rows.where(F.col("rank") <= first).join(totals, "lang")
    return rows.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"),
        "most_left", "most_right",
    )


ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
    select lang, m, array_to_string(w[i:i + m - 1], ' ') as gram, w[i:i + m - 1] as words
    from worded, (values (1), (2), (3), (4)) as sizes(m), unnest(range(1, greatest(len(w) - m + 2, 1))) as places(i)
), counted as (select lang, m, gram, any_value(words) as words, count(*) as a from grams group by all having count(*) >= 30),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
covered as (
    select distinct p.lang, p.gram from counted p
    join (select lang, m, a, unnest([array_to_string(words[1:m - 1], ' '), array_to_string(words[2:m], ' ')]) as gram
          from counted where m > 2) q
    on p.lang = q.lang and p.gram = q.gram and p.m = q.m - 1 and p.m > 1 and 100 * q.a::hugeint >= 80 * p.a::hugeint
), cuts as (
    select c.lang, c.gram, c.m, c.a, k, array_to_string(words[1:k], ' ') as head, array_to_string(words[k + 1:m], ' ') as tail
    from counted c, (values (1), (2), (3)) as ks(k) where c.m > k and (c.lang, c.gram) not in (select lang, gram from covered)
), scored as (
    select cuts.lang, cuts.gram as phrase, cuts.a, x.a as l, y.a as r, k, (2000000::hugeint * cuts.a) // (x.a + y.a)::hugeint as score
    from cuts join counted x on x.lang = cuts.lang and x.gram = cuts.head and x.m = cuts.k
    join counted y on y.lang = cuts.lang and y.gram = cuts.tail and y.m = cuts.m - cuts.k
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
"""
