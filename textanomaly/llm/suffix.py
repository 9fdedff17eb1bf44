"""Removal of repeated byte strings by sorting suffixes from places that the bytes themselves choose.

Every string of 100 bytes is tied to its anchor, the leftmost of the smallest hashes of the 32-byte strings in it, so equal
strings have an equal anchor at the same distance. An anchor's strings are neighbours and make one stretch of bytes;
stretches are the suffixes that are sorted, one for some 35 starts. Only those around anchors that occur twice are made.

Suffixes that share their whole stretch come together, and in all but the earliest every string is a repeat. The earliest
ones are looked at again in cells of 23, then 6, then single distances from the anchor. All strings of a cell hold the
same middle bytes, so a suffix whose middle is its own has no repeat there and goes no further. The last cells hold one
string of 100 bytes each: nothing is left to compare, and no step looks at hashes in place of bytes.

Before that, of equal texts the first is kept alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import PIECE_BYTES, Scratch, mixed, pieces, ranked
from textanomaly.session import broadcast_if_small, shuffles_removed

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1  # starts of grams in a string of LENGTH bytes
CELLS = (REACH, 23, 6, 1)  # distances from the anchor that are looked at together
PLACE_BITS = 31  # of a text's number and a place in it, kept as one number; no text has more bytes
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of at least ``LENGTH`` bytes, and how far before an anchor its strings
    start: least and most. Every start of a string belongs to one anchor."""
    values = mixed(data.astype(np.uint64) + np.uint64(1))
    width, hashes = 1, values
    while width < GRAM:  # hashes of twice as many bytes from two neighbours
        hashes = mixed(hashes[: len(hashes) - width] * _BASE + hashes[width:])
        width *= 2

    def least(step: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        left = low[:count] <= low[step : step + count]
        return np.minimum(low[:count], low[step : step + count]), np.where(left, at[:count], at[step : step + count])

    low, at, span = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while 2 * span <= REACH:
        low, at = least(span, len(low) - span)
        span *= 2
    starts = len(hashes) - REACH + 1
    low, at = least(REACH - span, starts)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    place = at[first].astype(np.int64)
    return place, low[first], place - np.append(first[1:], starts) + 1, place - first


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "data"):
        rows = []
        for ord_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, hashes, near, far = anchors(np.frombuffer(data, np.uint8))
            rows.append((hashes.view(np.int64), np.full(len(at), ord_, np.int64), at, near.astype(np.int8), far.astype(np.int8)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["hash", "ord", "at", "near", "far"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a text's repeated anchors: the strings that start ``near`` to ``far`` bytes before them."""
    rows, size = [], 0
    for batch in batches:
        for ord_, data, found in zip(*(batch.column(i) for i in range(3))):
            at, near, far = (found.values.field(name).to_numpy() for name in ("at", "near", "far"))
            starts, lengths = at - far, far.astype(np.int64) - near + LENGTH
            ends = np.cumsum(lengths)
            # bytes of all stretches one after the other
            taken = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
            text = np.frombuffer(data.as_py(), np.uint8)[taken]
            offsets = pa.py_buffer(np.append(0, ends).astype(np.int32))
            part = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(text)])
            place = pa.array((ord_.as_py() << PLACE_BITS) + at)
            rows.append(pa.RecordBatch.from_arrays([place, pa.array(near), pa.array(far), part], ["place", "near", "far", "part"]))
            size += len(text)
            if size > PIECE_BYTES:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                rows, size = [], 0
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


SUFFIX = "place long, near byte, far byte, part binary"


def _cells(rows: DataFrame, width: int) -> DataFrame:
    """Suffixes cut into cells of ``width`` distances from their anchor."""
    cells = F.sequence(F.floor(F.col("near") / width), F.floor(F.col("far") / width))
    cut = rows.withColumn("cell", F.explode(cells)).withColumn("low", (F.col("cell") * width).cast("int"))
    near, far = F.greatest("near", "low").cast("byte"), F.least(F.col("far").cast("int"), F.col("low") + (width - 1)).cast("byte")
    cut = cut.withColumns({"cut_near": near, "cut_far": far})
    part = F.substring("part", F.col("far") - F.col("cut_far") + 1, F.col("cut_far") - F.col("cut_near") + LENGTH)
    return cut.select("place", F.col("cut_near").alias("near"), F.col("cut_far").alias("far"), part.alias("part"))


def _with_middle(rows: DataFrame, width: int) -> DataFrame:
    """Add the cell and the bytes that all strings of ``LENGTH`` bytes in it hold, whichever of them a suffix has."""
    low = (F.floor(F.col("near") / width) * width).cast("int")
    middle = F.substring("part", F.col("far") - low + 1, F.lit(LENGTH + 1 - width))
    return rows.withColumns({"low": low, "middle": middle})


def repeated_ranges(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(ord, start, stop): bytes of strings of LENGTH bytes in suffixes (SUFFIX) that also start earlier."""
    found, key = None, ["near", "far", "part"]
    for i, width in enumerate(CELLS):
        cut = f"cut{i}"
        if i:
            rows = scratch.store(_cells(rows, width), cut)
            scratch.drop(f"open{i - 1}")
        heads = rows.groupBy(*key).agg(F.min("place").alias("head"), F.count("*").alias("n"))
        heads = scratch.store(heads, f"heads{i}")
        copies = rows.join(heads.where("n > 1"), key).where("place <> head")
        at = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
        start, stop = at - F.col("far"), at - F.col("near") + LENGTH
        copies = copies.select(F.shiftright("place", PLACE_BITS).alias("ord"), start.alias("start"), stop.alias("stop"))
        copies = scratch.store(copies, f"copies{i}")
        found = copies if found is None else found.unionByName(copies)
        scratch.drop(cut if i else "suffixes")
        if width > 1:
            # the earliest ones alone still meet each other, where they share their middle
            open_ = _with_middle(heads.select(F.col("head").alias("place"), *key), width)
            shared = open_.groupBy("low", "middle").agg(F.count("*").alias("n")).where("n > 1").select("low", "middle")
            shared = scratch.store(shared, f"shared{i}")
            rows = scratch.store(open_.join(shared, ["low", "middle"], "left_semi").select("place", *key), f"open{i}")
            scratch.drop(f"shared{i}")
        scratch.drop(f"heads{i}")
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ord", "n_removed", "n_spans", "kept_sha256", "spans"]
    for batch in batches:
        rows = []
        for ord_, data, ranges in zip(*(batch.column(i) for i in range(3))):
            ord_, data = ord_.as_py(), data.as_py()
            marks = np.zeros(len(data) + 1, np.int32)
            if ranges.is_valid:
                np.add.at(marks, ranges.values.field("start").to_numpy(), 1)
                np.add.at(marks, ranges.values.field("stop").to_numpy(), -1)
            gone = np.cumsum(marks[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((ord_, int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.reshape(-1, 2).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed runs) of every row.

    Texts are UTF-8 bytes (null: none). Earlier means a smaller doc_id, then a smaller place; a null doc_id comes last,
    texts that share a doc_id come in the order of their SHA-256, and rows that are equal count once and get equal
    results. Of equal texts of at least LENGTH bytes all but the first go whole.
    """
    with shuffles_removed(docs.sparkSession):
        return _remove_repeats(docs, Scratch(docs, "suffix"))


def _remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    rows = rows.withColumns({"sha": F.sha2("data", 256), "n_bytes": F.octet_length("data").cast("long")})
    plain = scratch.store(rows.select("doc_id", "sha", "n_bytes"), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    texts = plain.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min(place).alias("place"))
    texts = texts.select("sha", F.col("place.doc_id").alias("head"))
    texts = scratch.store(ranked(texts, [F.col("head").isNull(), F.col("head"), F.col("sha")], "ord"), "texts")
    side = broadcast_if_small(texts.select(F.col("sha").alias("own_sha"), "head", "ord"))
    first = (F.col("sha") == F.col("own_sha")) & F.col("doc_id").eqNullSafe(F.col("head"))
    heads = rows.join(side, first).dropDuplicates(["ord"]).select("ord", "data")
    heads = scratch.store(heads, "heads")
    found = scratch.store(heads.mapInArrow(_anchor_rows, "hash long, ord long, at long, near byte, far byte"), "anchors")
    # stored, so that the join is a stage of its own and a frequent hash is dealt over several tasks
    hashes = scratch.store(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "hashes")
    twice = scratch.store(found.join(hashes, "hash", "left_semi").drop("hash"), "twice")
    scratch.drop("anchors", "hashes")
    twice = twice.groupBy("ord").agg(F.collect_list(F.struct("at", "near", "far")).alias("found"))
    suffixes = heads.join(twice, "ord").select("ord", "data", "found").mapInArrow(_suffixes, SUFFIX)
    suffixes = scratch.store(suffixes, "suffixes")
    scratch.drop("twice")
    repeats = repeated_ranges(suffixes, scratch).groupBy("ord").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    schema = "ord long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>"
    done = heads.join(repeats, "ord", "left").select("ord", "data", "ranges").mapInArrow(_removed, schema)
    done = scratch.store(done.join(texts, "ord").drop("ord"), "done")
    scratch.drop("heads", "texts", *[f"copies{i}" for i in range(len(CELLS))])
    all_of_it = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    head_rows = plain.join(
        done.withColumnsRenamed({"sha": "own_sha"}), (F.col("sha") == F.col("own_sha")) & F.col("doc_id").eqNullSafe(F.col("head")), "left"
    )
    copy, short = F.col("own_sha").isNull() & (F.col("n_bytes") >= LENGTH), F.col("n_bytes") < LENGTH
    return head_rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(short, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(short, F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(short, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, all_of_it).when(short, F.array().cast("array<array<bigint>>")).otherwise(F.col("spans")).alias("spans"),
    )
