"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

A piece of the texts becomes Arrow arrays: token lists are flattened next to their document's number, a running sum of
token bytes less what earlier documents took gives each token's end, and an Acero hash join on document and end finds
where both tokenizers end a token. Ends of either side, in order, cut a document into stretches that one token of each
side covers: its links. They are counted by ``Table.group_by`` in every task, and Spark adds the tasks' counts up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textanomaly.llm.common import Scratch, pieces
from textanomaly.session import broadcast_if_small

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 20  # bytes of text at a time
HELD_PAIRS, ROW_PAIRS = 1 << 20, 1 << 16  # distinct pairs a task adds up before it hands them on; in one row
END_BITS = 40  # of a token's end within its document
# Fixed value: how byte-level vocabularies of this kind split texts before merging.
USUAL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_PIECE = re.compile(r"\S{1000}|\s{1000}")  # merged in quadratic time by the faster encoder
_LOADED: dict[tuple[str, str], tuple] = {}


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer's encoder and, by token id, bytes, number of bytes and the id in decimal."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.size = encode, len(tokens)
        self.bytes = pa.array(tokens, pa.large_binary())
        self.widths = pc.binary_length(self.bytes).cast(pa.int64())
        self.decimals = pa.array([str(i) for i in range(len(tokens))], pa.large_string())


def _by_ranks(tokenizer, tokens: list[bytes]):
    """A faster encoder of the same vocabulary where ids rank the merges and pieces are the usual ones; else None."""
    from tiktoken import Encoding

    told = json.loads(tokenizer.to_str())
    model, split = told["model"], told["pre_tokenizer"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    usual = told["normalizer"] is None and (split or {}).get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    if not usual or model["type"] != "BPE" or [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    ranks = {tokens[i]: i for i in model["vocab"].values()}
    return Encoding("ranks", pat_str=USUAL_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _byte_level_encoder(tokenizer, tokens: list[bytes]):
    fast = _by_ranks(tokenizer, tokens)

    def encode(texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        slow = [fast is None or LONG_PIECE.search(t) is not None for t in texts]
        left = [t for t, s in zip(texts, slow) if s]
        rest = iter([e.ids for e in tokenizer.encode_batch_fast(left, add_special_tokens=False)] if left else [])
        return [next(rest) if s else fast(t) for t, s in zip(texts, slow)]

    return encode


def load(first: str, second: str) -> tuple[Side, Side]:
    """The byte-level tokenizer (a tokenizers file) and the piece tokenizer (a sentencepiece file), once a worker."""
    if (first, second) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(first)
        a.encode_special_tokens = True
        bytes_of = _byte_level()
        tokens = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            tokens[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        b = SentencePieceProcessor(model_file=second)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        spelt = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        _LOADED[first, second] = Side(_byte_level_encoder(a, tokens), tokens), Side(lambda texts: b.encode(texts, num_threads=1), spelt)
    return _LOADED[first, second]


def _spelt(side: Side, ids: pa.ListArray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, side.bytes.take(ids.values)), pa.scalar(b"", pa.large_binary()))


def _ends(side: Side, ids: pa.ListArray) -> pa.Table:
    """Document-end keys of all tokens and their places."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(side.widths.take(flat))])
    before = total.take(ids.offsets[:-1])
    ends = pc.subtract(total.slice(1), before.take(parents))
    key = pc.add(pc.shift_left(parents.cast(pa.int64()), END_BITS), ends)
    return pa.table({"key": key, "at": pa.array(np.arange(len(flat)))})


def _joined(strings: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    """Runs of ``strings`` up to each end, each as one string."""
    offsets = pa.array(np.append(0, ends), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), pa.scalar(separator, pa.large_string()))


def aligned(a: Side, b: Side, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Tokens, groups and links of each text, its groups as text, and its distinct pairs with their counts."""
    texts = [t or "" for t in texts]
    lists = [pa.array(side.encode(texts), pa.list_(pa.int32())) for side in (a, b)]
    wanted = pa.array([b" " + t.encode() for t in texts], pa.large_binary())
    good = np.array([bool(t) for t in texts])
    for side, ids in zip((a, b), lists):
        good &= np.asarray(pc.equal(_spelt(side, ids), wanted))
    if not good.all():
        lists = [pa.array([v if g else [] for v, g in zip(ids.to_pylist(), good)], pa.list_(pa.int32())) for ids in lists]
    first, second = _ends(a, lists[0]), _ends(b, lists[1])
    ends = first.join(second, "key", join_type="full outer", right_suffix="_b", use_threads=False).sort_by("key").combine_chunks()
    at_a, at_b = (ends[c].combine_chunks() if ends.num_rows else pa.array([], pa.int64()) for c in ("at", "at_b"))
    docs = np.asarray(ends["key"]) >> END_BITS
    shared = np.asarray(pc.and_(at_a.is_valid(), at_b.is_valid())).astype(bool)
    # a stretch belongs to the token of either side that ends next
    tokens_a = lists[0].values.take(pc.fill_null_backward(at_a)).cast(pa.int64())
    tokens_b = lists[1].values.take(pc.fill_null_backward(at_b)).cast(pa.int64())
    links = pa.table({"doc": docs, "pair": pc.add(pc.multiply(tokens_a, b.size), tokens_b)})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    if (np.diff(np.asarray(pairs["doc"])) < 0).any():
        pairs = pairs.sort_by("doc")
    n_groups = np.bincount(docs[shared], minlength=len(texts))
    sides = [
        _joined(side.decimals.take(ids.values), np.asarray(at.filter(pa.array(shared))) + 1, ",")
        for side, ids, at in ((a, lists[0], at_a), (b, lists[1], at_b))
    ]
    groups = _joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), np.cumsum(n_groups), ";").to_pylist()
    numbers = {
        "n_a": np.asarray(pc.list_value_length(lists[0])), "n_b": np.asarray(pc.list_value_length(lists[1])),
        "n_groups": n_groups, "n_links": np.bincount(docs, minlength=len(texts)),
    }
    return numbers, groups, pairs


FOUND = """row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    pairs array<long>, counts array<long>"""
_NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]


def _by_pair(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def _partial(pairs: pa.Table) -> pa.RecordBatch:
    """Counts of a task so far, in rows without a document."""
    cuts = np.append(np.arange(0, pairs.num_rows, ROW_PAIRS), pairs.num_rows)
    rows = len(cuts) - 1
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs[c].combine_chunks()) for c in ("pair", "n")]
    empty = [pa.nulls(rows, pa.int64())] * 6 + [pa.nulls(rows, pa.string())]
    return pa.RecordBatch.from_arrays([*empty, *lists], _NAMES)


def _aligner(first: str, second: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(first, second)
        row, held = TaskContext.get().partitionId() << 40, []
        for batch in pieces(batches, most=PIECE):
            numbers, groups, pairs = aligned(a, b, batch.column(1).to_pylist())
            rows = batch.num_rows
            offsets = pa.array(np.searchsorted(np.asarray(pairs["doc"]), np.arange(rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pairs[c].combine_chunks()) for c in ("pair", "count_all")]
            arrays = [
                pa.array(np.arange(row, row + rows)), batch.column(0), *(pa.array(v, pa.int64()) for v in numbers.values()),
                pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()), *lists,
            ]
            row += rows
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)
            held.append(pairs.select(["pair", "count_all"]).rename_columns(["pair", "n"]))
            if sum(t.num_rows for t in held) > 2 * HELD_PAIRS:
                held = [_by_pair(held)]
                if held[0].num_rows > HELD_PAIRS:
                    yield _partial(held.pop())
        if held and (rest := _by_pair(held)).num_rows:
            yield _partial(rest)

    return align


def _exploded(df: DataFrame, *also: str) -> DataFrame:
    return df.select(*also, F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        *also, F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links")
    )


def align(docs: DataFrame, folder: str = FOLDER, first: str = BYTE_LEVEL, second: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A null or empty text, and one whose tokens don't spell a space and the text on both sides, has no tokens: zeros, and
    an empty hash. Repeated rows are returned and counted each; null ids stay null. A very long text is encoded whole,
    by itself. Best links have the highest count of their second token's in all documents, ties included.
    """
    first, second = f"{folder}/{first}", f"{folder}/{second}"
    scratch = Scratch(docs, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scratch.store(rows.mapInArrow(_aligner(first, second), FOUND), "found")
    size = load(first, second)[1].size
    counts = _exploded(found.where("row is null")).groupBy("pair").agg(F.sum("links").alias("n"))
    # at most a row for every token of the first vocabulary
    own = Window.partitionBy(F.col("pair") % size)
    counts = scratch.store(counts.withColumn("best", F.col("n") == F.max("n").over(own)), "counts")
    texts = found.where("row is not null")
    linked = _exploded(texts, "row").join(broadcast_if_small(counts), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")
    )
    facts = texts.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("long")
    return facts.join(linked, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )


def pair_counts(docs: DataFrame, folder: str = FOLDER, first: str = BYTE_LEVEL, second: str = PIECES) -> DataFrame:
    """a, b, n: how many links hold each pair of token ids."""
    first, second = f"{folder}/{first}", f"{folder}/{second}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = Scratch(docs, "alignment").store(rows.mapInArrow(_aligner(first, second), FOUND), "found")
    counts = _exploded(found.where("row is null")).groupBy("pair").agg(F.sum("links").alias("n"))
    size = load(first, second)[1].size
    return counts.select(F.floor(F.col("pair") / size).alias("a"), (F.col("pair") % size).alias("b"), "n")
