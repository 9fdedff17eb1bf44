"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside blocks, components of the links.

Equal fingerprints are one node. Two fingerprints that differ in at most three bits agree in at least two of
five parts of their 64 bits, so each node goes to one bucket for every pair of parts (ten in all) and only
nodes of a bucket are compared. A task stores its nodes as 64 bit planes, one bit a node, and compares all of
them with their neighbours at the same distance at once: the planes' differences go through a carry-save
counter of a few bits, and blocks in which every count is over the radius are dropped before the next planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.common import pieces, stored, text_bytes
from textanomaly.session import broadcast_if_small

RADIUS = 3
SHINGLE = 3
SEED = 42
# five parts of 64 bits: (lowest bit, width)
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# a bucket of more nodes is compared in pairs of chunks, each pair by a task
CHUNK = 8192
PLANES_BETWEEN_CHECKS = 8


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the space-joined shingles of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number; 0 without words."""
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        prints = [fingerprint(t) for t in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Planes:
    """Bit planes of sorted fingerprints, one bit a node; shifted words are read past the end as zero."""

    def __init__(self, prints: np.ndarray):
        bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        words = -(-len(prints) // 64)
        packed = np.zeros((64, 8 * (2 * words + 2)), np.uint8)
        rows = np.packbits(bits.T, axis=1, bitorder="little")
        packed[:, : rows.shape[1]] = rows
        self.words, self.planes = words, packed.view("<u8")

    def far(self, shift: int, where: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Words (of those in ``where``) and their bits for nodes within the radius of the node ``shift`` further on."""
        skip, turn = divmod(shift, 64)
        right, left = np.uint64(turn), np.uint64(64 - turn if turn else 0)
        width = max(1, radius.bit_length())
        # counters start so that the carry out of the highest bit says "over the radius"
        start = (1 << width) - 1 - radius
        full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
        counter = [np.full(len(where), full if start >> b & 1 else none) for b in range(width)]
        for plane in range(64):
            row = self.planes[plane]
            other = row[where + skip]
            if turn:
                other = (other >> right) | (row[where + skip + 1] << left)
            carry = row[where] ^ other
            for b in range(width):
                counter[b], carry = counter[b] ^ carry, counter[b] & carry
            alive = alive & ~carry
            if plane % PLANES_BETWEEN_CHECKS == PLANES_BETWEEN_CHECKS - 1:
                kept = np.flatnonzero(alive)
                if not len(kept):
                    return where[:0], alive[:0]
                if len(kept) < len(where):
                    where, alive = where[kept], alive[kept]
                    counter = [c[kept] for c in counter]
        return where, alive


def bucket_links(prints: np.ndarray, buckets: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join nodes within the radius and the same bucket (rows sorted by bucket).

    Only links between parts that earlier ones have not joined are returned, so there are fewer links than
    nodes; the components are those of all links.
    """
    count = len(prints)
    if count < 2:
        return []
    ends = np.append(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, count)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(count)  # nodes to the end of the bucket
    planes, root, links = Planes(prints), np.arange(count), []
    for shift in range(1, int(left.max())):
        valid = np.packbits(left > shift, bitorder="little")
        words = np.zeros(8 * planes.words, np.uint8)
        words[: len(valid)] = valid
        words = words.view("<u8")
        where = np.flatnonzero(words)
        found, bits = planes.far(shift, where, words[where], radius)
        if not len(found):
            continue
        lanes = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(lanes)
        one = found[at] * 64 + bit
        apart = one[root[one] != root[one + shift]]
        for a in apart.tolist():
            low, high = sorted((_root(root, a), _root(root, a + shift)))
            if low != high:
                root[high] = low
                links.append((int(prints[a]), int(prints[a + shift])))
        if len(apart):
            while not np.array_equal(root, root[root]):
                root = root[root]
    return links


def _root(root: np.ndarray, node: int) -> int:
    while root[node] != node:
        node = int(root[node])
    return node


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by bucket; a bucket may go on in the next batch."""
    rest = np.zeros((0, 2), np.int64)

    def links(rows):
        found = np.array(bucket_links(rows[:, 1], rows[:, 0]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
        rest = np.concatenate([rest, rows])
        whole = np.searchsorted(rest[:, 0], rest[-1, 0]) if len(rest) else 0
        if whole:
            yield links(rest[:whole])
            rest = rest[whole:]
    if len(rest):
        yield links(rest)


def fingerprint_links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): fingerprints within the radius, enough of them to join all that links join.

    ``nodes`` has one row a distinct fp. Buckets above ``chunk`` rows are dealt out in pairs of chunks.
    """
    keys = []
    for table, pair in enumerate(combinations(PARTS, 2)):
        key = F.lit(table)
        for low, width in pair:
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key.cast("long"), width).bitwiseOR(part)
        keys.append(key)
    placed = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = placed.groupBy("key").count().where(F.col("count") > chunk)
    hot = sizes.select(F.col("key").alias("hot"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    hot = stored(hot, "simhash-hot")
    placed = placed.join(broadcast_if_small(hot), F.col("key") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own)
    )
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)
    # a key has at most 30 bits, which leaves 33 for the pair of chunks
    bucket = F.shiftleft(F.col("key"), 33).bitwiseOR(F.col("pair").cast("long"))
    dealt = placed.select("fp", "key", F.explode(pairs).alias("pair")).select(bucket.alias("bucket"), "fp")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges lead to, for every node of ``edges`` (a, b).

    Alternates large stars and small stars: every node hands its neighbours the smallest one it knows, until
    the edges stay as they are. Each round is a few joins; the rounds grow with the logarithm of the size.
    """
    current = stored(edges.where("a <> b").distinct(), "components")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
        before = tuple(state)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stored(large, "components")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = stored(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to) of every row of ``docs``.

    Rows of equal fingerprint are linked, those without words too. A null doc_id is never the smallest; a
    component without any has a null component_id. Other columns of ``docs`` are not looked at.
    """
    rows = stored(fingerprints(docs), "simhash-prints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    members = components(fingerprint_links(nodes.select("fp")))
    rooted = nodes.join(members, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Of rows that share the smallest doc_id that of the smallest fingerprint stays, then that of the smallest text, once;
    rows of other groups with the same doc_id stay too. Of a group without any doc_id one row stays.
    """
    marked = near_duplicates(docs)
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("doc_id").alias("__id"), F.min("fp").alias("__fp")
    )
    kept = stored(kept.select("__id", "__fp"), "simhash-kept")
    ids = marked.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    several = stored(ids.where("__n > 1").select("__id"), "simhash-several")
    of_id = F.col("doc_id") == F.col("__id")
    result = docs.join(kept.where("__id is not null").select("__id").distinct(), of_id, "left_semi")
    if not several.isEmpty():
        result = result.join(several, of_id, "left_anti")
        result = result.unionByName(_chosen(docs.join(several, of_id, "left_semi"), kept))
    if not kept.where("__id is null").isEmpty():
        result = result.unionByName(_chosen(docs.where("doc_id is null"), kept))
    return result


def _chosen(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Of ``rows``, whose doc_id doesn't tell them apart, one for each (doc_id, fingerprint) of ``kept``."""
    texts = rows.select(F.col("doc_id").alias("__own"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    kind = texts.schema["__own"].dataType.simpleString()
    prints = texts.select("text", "__own").mapInArrow(_text_prints, f"text string, __own {kind}, fp long")
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp"))
    chosen = prints.join(kept, same).groupBy("__own", "__fp").agg(F.min("text").alias("__text"))
    wanted = F.col("doc_id").eqNullSafe(F.col("__own")) & (F.coalesce("text", F.lit("")) == F.col("__text"))
    found = rows.join(chosen.select("__own", "__text"), wanted, "left_semi")
    return found.withColumn("__t", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "__t"]).drop("__t")


def _text_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        prints = pa.array([fingerprint(t) for t in text_bytes(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, "fp"])
