"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are gathered in shards of their hash. A shard's filter holds a key once for every step
of the logarithm of its count; a lookup probes one step after the other until one is missing, which gives the quantised
count. With D the discount, the probability of a word after another is

    (count(pair) - D) / count(first)  +  mass(first) * (count(word) + 1) / (N + V + 1)

where mass is what the pairs held leave over, measured on the training texts by step of count(first).

A filter is blocked: all probes of a key's step fall into one word of 64 bits. Filters and exact word counts are
broadcast in waves of bounded size. The distinct n-grams of each bundle of texts are stored once, by the wave that knows
them, so texts are not read again for each wave: a wave answers its own part, and the answers meet their bundle at the
end. The steps found don't depend on how many waves there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textanomaly.llm.classifier import fold
from textanomaly.llm.common import Scratch, Words, mixed, pieces, text_bytes
from textanomaly.session import small_batches

BASE = 1.3  # of the logarithm that counts are quantised by
BITS, PROBES = 12, 5  # of the filter, a held step
DISCOUNT = 0.75
FLUSH_TOKENS = 2 << 20
PIECE = 1 << 20  # bytes of text counted at a time
BUNDLES = 8  # of texts, or of their n-grams, that Python is handed at a time
ROW_GROUP = 16 << 20  # bytes of bundles that a reader holds at a time
WAVE_BYTES = 128 << 20
SHARD_TEXT = 8 << 20  # bytes of training text that a shard has the n-grams of, about
END = np.uint64(0x5851F42D4C957F2D)  # the hash of the token that ends a text, and stands before its first word
_PAIR, _PROBE, _LOW = np.uint64(0xD1342543DE82EF95), 0x9E3779B97F4A7C15, np.uint64(0xFFFFFFFF)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of their pairs with the token before, and where each text's begin."""
    words = Words(texts)
    counts = words.counts + 1
    first = np.append(0, np.cumsum(counts))
    found = np.full(first[-1], END, np.uint64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    found[inside] = words.hashes() if len(words) else np.zeros(0, np.uint64)
    before = np.append(END, found[:-1])  # each text's end stands before the next one's first word
    return found, mixed(before * _PAIR + mixed(found)), first


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _counter(shard_bits: int):
    def flush(kind: int, parts: list) -> Iterator[dict]:
        keys, counts = _counted(parts)
        shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64)
        for s, start, end in zip(*_runs(shard)):
            yield {"kind": kind, "shard": s, "keys": _packed_keys(keys[start:end]), "counts": _packed(counts[start:end].astype("<u4").tobytes())}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        parts, held = {1: [], 2: []}, 0
        for batch in pieces(batches, most=PIECE):
            one, two, _ = tokens(text_bytes(batch))
            for kind, found in ((1, one), (2, two)):
                parts[kind].append(np.unique(found, return_counts=True))
            held += len(one)
            if held > FLUSH_TOKENS:
                for kind in parts:
                    yield pa.RecordBatch.from_pylist(list(flush(kind, parts[kind])), schema)
                parts, held = {1: [], 2: []}, 0
        if held:
            for kind in parts:
                yield pa.RecordBatch.from_pylist(list(flush(kind, parts[kind])), schema)

    return count


def _runs(values: np.ndarray) -> tuple[list, list, list]:
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))[: len(values)]
    return values[starts].tolist(), starts.tolist(), np.append(starts[1:], len(values)).tolist()


def steps_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of one, and one more for each power of ``BASE``."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(steps: np.ndarray) -> np.ndarray:
    """The count in the middle of a step; 0 for none."""
    low = np.ceil(BASE ** (steps - 1.0))
    return np.where(steps > 0, (low + np.maximum(low, np.ceil(BASE ** (steps * 1.0)) - 1)) / 2, 0.0)


def _probes(keys: np.ndarray, step: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word, of as many as its filter has, that a key's step falls into, and the hash its bits there follow from."""
    hashed = mixed(keys + np.uint64(step * _PROBE % (1 << 64)))
    return (((hashed & _LOW) * words) >> np.uint64(32)).astype(np.int64), hashed >> np.uint64(32)


def _bit(high: np.ndarray, probe: int) -> np.ndarray:
    return (high >> np.uint64(6 * probe)) & np.uint64(63)


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of a shard as bytes."""
    steps = steps_of(counts)
    words = max(1, -(-int(steps.sum()) * BITS // 64))
    bits = np.zeros(64 * words, bool)
    for step in range(1, int(steps.max(initial=0)) + 1):
        place, high = _probes(keys[steps >= step], step, np.uint64(words))
        for probe in range(PROBES):
            bits[64 * place + _bit(high, probe).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


SHARD = "kind int, shard long, types long, total long, singles binary, keys binary, counts binary, bits binary"


def _shard(key, table):
    kind, shard = key[0].as_py(), key[1].as_py()
    blobs = zip(table["keys"].to_pylist(), table["counts"].to_pylist())
    parts = [(_unpacked_keys(k), np.frombuffer(_unpacked(c), "<u4").astype(np.int64)) for k, c in blobs]
    keys, counts = _counted(parts)
    once = (counts == 1) & (kind == 1)
    often = (counts > 1) & (kind == 1)
    row = {
        "kind": kind, "shard": shard, "types": len(keys), "total": int(counts.sum()),
        "singles": keys[once].tobytes(), "keys": keys[often].tobytes(), "counts": counts[often].astype("<i8").tobytes(),
        "bits": filter_bits(keys, counts).tobytes(),
    }
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join([r.pop(name) for r in rows]), kind)


class Wave:
    """What some shards know: exact counts of words, steps of words and pairs."""

    def __init__(self, rows: list[dict], shard_bits: int):
        """Takes the fields out of ``rows`` one by one, so that none is held twice for long."""
        self.shift = np.uint64(64 - shard_bits)
        rows.sort(key=lambda r: (r["kind"], r["shard"]))
        words = [r for r in rows if r["kind"] == 1]
        self.singles, self.keys = _joined(words, "singles", "<u8"), _joined(words, "keys", "<u8")
        self.counts = _joined(words, "counts", "<i8")
        self.filters = {}
        for kind in (1, 2):
            own = [r for r in rows if r["kind"] == kind]
            size = np.array([len(r["bits"]) // 8 for r in own], np.int64)
            shards = np.array([r["shard"] for r in own], np.int64)
            self.filters[kind] = shards, size, np.cumsum(size) - size, _joined(own, "bits", "<u8")

    def exact(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        for known, counts in ((self.singles, None), (self.keys, self.counts)):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                found[same] = 1 if counts is None else counts[at[same]]
        return found

    def steps(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Probe step after step until one is missing."""
        shards, size, offset, words = self.filters[kind]
        found = np.zeros(len(keys), np.uint8)
        if not len(shards):
            return found
        shard = (keys >> self.shift).astype(np.int64)
        own = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
        alive = np.flatnonzero(shards[own] == shard)
        own, keys, step = own[alive], keys[alive], 1
        while len(alive) and step < 255:
            place, high = _probes(keys, step, size[own].astype(np.uint64))
            wanted = np.zeros(len(keys), np.uint64)
            for probe in range(PROBES):
                wanted |= np.uint64(1) << _bit(high, probe)
            held = np.flatnonzero(words[offset[own] + place] & wanted == wanted)
            alive, own, keys = alive[held], own[held], keys[held]
            found[alive] = step
            step += 1
        return found


BUNDLE = "bundle long, doc_id array<long>, held_out array<boolean>, sizes array<long>, text binary"
ASKED = "bundle long, wave int, one binary, two binary"
ANSWER = "bundle long, one binary, two binary, counts binary"
NOTES = "doc_id long, held_out boolean, one binary, two binary, n_known long, log_sum double"


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else b""


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, all first bytes before all second ones: the last are nearly always zero."""
    steps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    return _packed(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked_keys(data: bytes) -> np.ndarray:
    steps = np.frombuffer(_unpacked(data), np.uint8).reshape(8, -1).T.tobytes()
    return np.cumsum(np.frombuffer(steps, "<u8"), dtype=np.uint64)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts a row, compressed together, since they are shuffled once; a null one is empty."""
    first = TaskContext.get().partitionId() << 32
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    for number, batch in enumerate(pieces(batches)):
        texts = text_bytes(batch)
        row = [first + number, batch.column(0).to_pylist(), batch.column(1).to_pylist(), [*map(len, texts)], _packed(b"".join(texts))]
        columns = ["bundle", "doc_id", "held_out", "sizes", "text"]
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], columns)


def _texts(packed: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a bundle."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64).tolist()
    data = _unpacked(packed)
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _asker(waves: int, shard_bits: int):
    """The distinct n-grams of each bundle, a row for each wave that knows some."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.int64()), ("wave", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])
        for batch in batches:
            for bundle, sizes, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows: dict[int, dict] = {}
                for name, found in zip(("one", "two"), tokens(_texts(packed, sizes))):
                    keys = np.unique(found)
                    shard = keys >> np.uint64(64 - shard_bits)
                    wave = ((shard * np.uint64(waves)) >> np.uint64(shard_bits)).astype(np.int64)
                    for turn, start, end in zip(*_runs(wave)):
                        rows.setdefault(turn, {"bundle": bundle, "wave": turn, "one": b"", "two": b""})[name] = _packed_keys(keys[start:end])
                yield pa.RecordBatch.from_pylist(list(rows.values()), schema)

    return ask


def _answerer(wave):
    """The steps of a wave's n-grams, and its words' exact counts."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wave.value
        for batch in batches:
            answers = {"one": [], "two": [], "counts": []}
            for one, two in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                one, two = _unpacked_keys(one), _unpacked_keys(two)
                answers["one"].append(_packed(known.steps(1, one).tobytes()))
                answers["two"].append(_packed(known.steps(2, two).tobytes()))
                answers["counts"].append(_packed(known.exact(one).astype("<i8").tobytes()))
            arrays = [batch.column(0), *(pa.array(v, pa.binary()) for v in answers.values())]
            yield pa.RecordBatch.from_arrays(arrays, ["bundle", *answers])

    return answer


def _noted(table: pa.Table) -> pa.Table:
    """A bundle's texts with the steps of their tokens, from the bundle itself (wave -1) and its answers in order."""
    rows = sorted(table.select(["wave", "one", "two", "counts"]).to_pylist(), key=lambda r: r["wave"])[1:]
    own = table.filter(pc.equal(table["wave"], -1)).select(["doc_id", "held_out", "sizes", "text"]).to_pylist()[0]
    one, two, first = tokens(_texts(own["text"], own["sizes"]))
    steps = {}
    for name, found in (("one", one), ("two", two)):
        _, place = np.unique(found, return_inverse=True)
        told = np.frombuffer(b"".join(_unpacked(r[name]) for r in rows), np.uint8)[place]
        steps[name] = [told[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        if name == "one":
            counts = np.frombuffer(b"".join(_unpacked(r["counts"]) for r in rows), "<i8")[place]
    return pa.table({
        "doc_id": pa.array(own["doc_id"], pa.int64()), "held_out": pa.array(own["held_out"], pa.bool_()),
        "one": pa.array(steps["one"], pa.binary()), "two": pa.array(steps["two"], pa.binary()),
        "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), first[:-1]), pa.int64()),
        "log_sum": pa.array(np.add.reduceat(np.log10(counts + 1.0), first[:-1]), pa.float64()),
    })


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens have each pair of steps: of the word before, and of the pair with it."""
    seen = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            before = np.append(one[-1], one[:-1]).astype(np.int64)
            seen += np.bincount(before << 8 | two, minlength=1 << 16)
    places = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(places >> 8), pa.array(places & 255), pa.array(seen[places])], ["step", "pair", "seen"])


def _scorer(mass: np.ndarray, total: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = count_of(np.arange(256))
        for batch in batches:
            scores = []
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                before = np.append(one[-1], one[:-1])  # the end stands before the first word
                pair, first = table[two], table[before]
                alone = (table[one] + 1) / total
                chance = np.maximum(pair - DISCOUNT, 0) / np.maximum(first, 1) * (first > 0) + mass[before] * alone
                scores.append(float(np.log10(np.minimum(chance, 1.0)).sum()))
            rest = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], [*batch.schema.names[2:], "score"])

    return score


def train(docs: DataFrame, shard_bits: int) -> DataFrame:
    """The shards of the model, a row each, from the rows of ``docs`` (text)."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _counter(shard_bits), "kind int, shard long, keys binary, counts binary"
    )
    return counted.groupBy("kind", "shard").applyInArrow(_shard, SHARD)


def score(docs: DataFrame, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are lower-cased (A-Z); every text, also a null or empty one, ends with one more token. Rows whose crc32 of
    the id modulo 7 is 2 are held out, the others train. Repeated rows count and are scored each. Without training rows
    N and V are 0. Scores are the same however the rows are laid out over files and partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 7) == 2).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    # shards follow from the texts alone, so scores don't depend on how rows are laid out
    texts = rows.where("not held_out").agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shard_bits = max(4, (texts // SHARD_TEXT).bit_length())
    scratch = Scratch(docs, "lm")
    with small_batches(spark):
        shards = scratch.store(train(rows.where("not held_out"), shard_bits), "shards")
        bundles = scratch.store(rows.mapInArrow(_bundled, BUNDLE), "bundles", options={"parquet.block.size": ROW_GROUP})
    known = shards.where("kind = 1").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")
    ).first()
    size = F.octet_length("singles") + F.octet_length("keys") + F.octet_length("counts") + F.octet_length("bits")
    in_all = shards.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    waves = max(1, -(-in_all // wave_bytes))
    with small_batches(spark, BUNDLES):
        asked = bundles.select("bundle", "sizes", "text").mapInArrow(_asker(waves, shard_bits), ASKED)
        asked = scratch.store(asked, "asked", by=["wave"], options={"parquet.block.size": ROW_GROUP})
        for turn in range(waves):
            own = shards.where(F.shiftright(F.col("shard") * waves, shard_bits) == turn)
            # a partition of the table of shards at a time, so that the driver holds the wave once
            rows_of_wave = [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in own.toLocalIterator()]
            shared = spark.sparkContext.broadcast(Wave(rows_of_wave, shard_bits))
            del rows_of_wave
            part = asked.where(F.col("wave") == turn).select("bundle", "one", "two")
            scratch.store(part.mapInArrow(_answerer(shared), ANSWER), f"answers/wave={turn}")
            shared.destroy()
            scratch.drop(f"asked/wave={turn}")
        scratch.drop("shards", "asked")  # before the bundles are shuffled
        answers = scratch.read("answers", f"{ANSWER}, wave int")
        told = bundles.withColumn("wave", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
        notes = scratch.store(told.groupBy("bundle").applyInArrow(_noted, NOTES), "notes")
    scratch.drop("bundles", "answers")
    left = notes.where("not held_out").select("one", "two").mapInArrow(_left_over, "step long, pair long, seen long")
    counts = np.zeros((256, 256))
    for row in left.groupBy("step", "pair").agg(F.sum("seen").alias("seen")).collect():  # 65,536 rows at most
        counts[row["step"], row["pair"]] = row["seen"]
    held = count_of(np.arange(256))
    taken, seen = counts @ np.where(held > 0, 1 - DISCOUNT / np.maximum(held, 1), 0), counts.sum(axis=1)
    mass = np.where(seen > 0, np.clip(1 - taken / np.maximum(seen, 1), 1e-3, 1), 1.0)
    mass[0] = 1.0
    total = known["n"] + known["v"] + 1
    scored = notes.select("one", "two", "doc_id", "held_out", F.octet_length("one").cast("long").alias("n_tokens"), "n_known", "log_sum")
    scored = scored.mapInArrow(
        _scorer(mass, float(total)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double",
    )
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(total)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
