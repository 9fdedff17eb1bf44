"""WARC archives: written as text records, read back by verified chains of record boundaries.

Writing: payloads equal by length and SHA-1 share one ``response`` record (of the largest page id); the
others become ``revisit`` records without a payload. Every task writes one file of records.

Reading: the files are cut at every occurrence of the record magic, wherever it stands, so also inside
payloads. A task reads its split in order and emits for each candidate where its own length says that the
next record starts. Chains are followed inside a split first; between splits, pointer jumping from the
start of each file finds the entries that are reached, in as many rounds as the logarithm of the number of
splits of a file. Only records on a chain from the start of their file are kept; a magic inside a payload
is never reached, and the pieces of the payload that held it are put together again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textanomaly.llm.common import shared_path, stored
from textanomaly.session import broadcast_if_small

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
# digits of base 32 as Spark's conv writes them, and as RFC 4648 does: fixed values
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def _header(value: Column) -> Column:
    """A value that can't break its header line."""
    return F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``.

    A null html is an empty payload, a null url or page_id has no header line. Of records with equal
    payloads of at least ``min_bytes`` bytes those with the largest page_id are responses (repeated rows
    all are), the others revisit it; without any page_id all are responses. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("digest"),
    )
    heads = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("bytes", "digest")
        .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .where("n > 1 and head is not null")
        .select(F.col("bytes").alias("head_bytes"), F.col("digest").alias("head_digest"), "head")
    )
    heads = broadcast_if_small(stored(heads, "warc-heads"))
    same = (F.col("bytes") == F.col("head_bytes")) & (F.col("digest") == F.col("head_digest"))
    joined = rows.join(heads, same, "left")
    older = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    kind = F.when(older, "revisit").otherwise("response")
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(older, F.lit("").cast("binary")).otherwise(F.col("payload"))
    length = F.octet_length(http) + F.octet_length(body)
    head = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "),
        kind,
        F.lit("\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", _header(F.col("url"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        _line(
            "WARC-Refers-To", F.when(older, F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">")))
        ),
        F.when(
            older, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
        ).otherwise(""),
        F.lit("Content-Length: "),
        length.cast("string"),
        F.lit(END),
        http,
    )
    record = F.concat(head.cast("binary"), body).cast("string")
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


RECORD = (
    "file string, block long, rel long, size long, next_rel long, exit_rel long, page_id long, url string, "
    "kind string, digest string, refers_to long, payload_bytes long, payload_digest string, whole boolean"
)
_FIELDS = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _candidate(chunk: bytes) -> dict | None:
    """What the text after a magic says, if it starts with a record's header."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.strip().lower(): v for k, v in _FIELDS.findall(chunk[: end + 2])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    last = end + 4 + int(length)
    found = {
        "next": len(MAGIC) + last + len(END),
        "page_id": _page(fields.get(b"warc-record-id")),
        "url": fields.get(b"warc-target-uri"),
        "kind": fields.get(b"warc-type", b"").decode("utf-8", "replace"),
        "digest": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:"),
        "refers_to": _page(fields.get(b"warc-refers-to")),
        "whole": len(chunk) >= last,
    }
    if found["whole"]:
        block = chunk[end + 4 : last]
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if block.startswith(b"HTTP/") and cut >= 0 else block
        found |= {"payload_bytes": len(payload), "payload_digest": _sha1(payload)}
    return found


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, position in the split of the piece's magic, piece) in the order of the file."""
    key, at = None, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, block) != key:
                key, at = (file, block), 0
            yield file, block, at - len(MAGIC), value
            at += len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = {"file": pa.string(), "url": pa.string(), "kind": pa.string(), "digest": pa.string()}
    kinds |= {"payload_digest": pa.string(), "whole": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def table(rows: list[dict]) -> pa.RecordBatch:
        # the first place outside the split that the chain of a record leads to
        exits: dict[int, int] = {}
        for row in reversed(rows):
            if row["next_rel"] is not None:
                row["exit_rel"] = exits[row["rel"]] = exits.get(row["next_rel"], row["next_rel"])
        return pa.RecordBatch.from_pylist(rows, schema)

    key, rows = None, []
    for file, block, rel, value in _splits(batches):
        if (file, block) != key:
            if rows:
                yield table(rows)
            key, rows = (file, block), []
        row = dict.fromkeys(names) | {"file": file, "block": block, "rel": rel, "size": len(value) + len(MAGIC)}
        if found := _candidate(value):
            row |= {"next_rel": rel + found.pop("next")}
            url = found.pop("url")
            row |= found | {"url": url.decode("utf-8", "replace") if url is not None else None}
        rows.append(row)
    if rows:
        yield table(rows)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def reached_entries(found: DataFrame) -> DataFrame:
    """(file, start): candidates of ``found`` (file, block, start, exit) where chains from a file's start enter a split."""
    targets = found.select("file", F.col("exit").alias("start")).distinct()
    first = found.where("start = 0").select("file", "start").distinct()
    jumps = found.select("file", "start", "exit").join(targets.union(first).distinct(), ["file", "start"], "left_semi")
    jumps = stored(jumps, "warc-jumps")
    reached = first
    while True:
        step = jumps.select("file", "start", F.col("exit").alias("to"))
        onward = reached.join(step, ["file", "start"]).select("file", F.col("to").alias("start"))
        grown = stored(reached.union(onward).distinct(), "warc-reached")
        there = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("onward"))
        doubled = jumps.join(there, ["file", "exit"]).select("file", "start", F.col("onward").alias("exit"))
        jumps = stored(doubled, "warc-jumps")
        reached = grown
        if jumps.isEmpty():
            return reached


def _walk(key, table):
    """Mark the candidates of a split on the chain from its entries."""
    starts, following = table["start"].to_pylist(), table["next"].to_pylist()
    step = dict(zip(starts, following))
    on_chain = set()
    for entry, is_entry in zip(starts, table["entry"].to_pylist()):
        while is_entry and entry in step and entry not in on_chain:
            on_chain.add(entry)
            entry = step[entry]
    rows = [(s, s in on_chain) for s in starts]
    return pa.table(
        {"file": table["file"], "start": pa.array(starts, pa.int64()), "on_chain": [r[1] for r in rows]}
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path`` that chains from the starts of the files reach.

    Returns page_id, url, record_type, refers_to, payload_bytes and payload_digest; the last two are of the
    payload as read (of the response referred to, for a revisit; null if there is none).
    """
    found = stored(_scan(spark, path).mapInArrow(_candidates, RECORD), "warc-candidates")
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "block", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    placed = found.join(broadcast_if_small(bases), ["file", "block"])
    for name, rel in (("start", "rel"), ("next", "next_rel"), ("exit", "exit_rel")):
        placed = placed.withColumn(name, F.col("base") + F.col(rel))
    placed = stored(placed.drop("base", "next_rel", "exit_rel"), "warc-placed")
    records = placed.where("next is not null")
    entries = reached_entries(records.select("file", "block", "start", "exit")).withColumn("entry", F.lit(True))
    chained = (
        records.select("file", "block", "start", "next")
        .join(broadcast_if_small(entries), ["file", "start"], "left")
        .withColumn("entry", F.coalesce("entry", F.lit(False)))
        .groupBy("file", "block")
        .applyInArrow(_walk, "file string, start long, on_chain boolean")
        .where("on_chain")
        .select("file", "start")
    )
    kept = stored(records.join(chained, ["file", "start"], "left_semi"), "warc-kept")
    split = kept.where("not whole").select("file", "start", "next")
    if not split.isEmpty():
        kept = kept.where("whole").unionByName(_reassembled(spark, path, placed, kept, split))
    heads = kept.where("kind = 'response'").select(
        F.col("page_id").alias("head_id"),
        F.col("digest").alias("head_digest"),
        F.col("payload_bytes").alias("head_bytes"),
        F.col("payload_digest").alias("head_payload"),
    )
    revisits = kept.where("kind = 'revisit'")
    heads = heads.dropDuplicates(["head_id", "head_digest"])
    same = (F.col("refers_to") == F.col("head_id")) & (F.col("digest") == F.col("head_digest"))
    resolved = revisits.join(heads, same, "left").select(
        "page_id", "url", F.col("kind").alias("record_type"), "refers_to",
        F.col("head_bytes").alias("payload_bytes"), F.col("head_payload").alias("payload_digest"),
    )
    plain = kept.where("kind <> 'revisit'").select(
        "page_id", "url", F.col("kind").alias("record_type"), "refers_to", "payload_bytes", "payload_digest"
    )
    return plain.unionByName(resolved)


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, rel, value in _splits(batches):
        columns = [[file], pa.array([block], pa.int64()), pa.array([rel], pa.int64()), pa.array([value], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], ["file", "block", "rel", "value"])


def _joined_payload(key, table):
    order = sorted(zip(table["start"].to_pylist(), table["value"].to_pylist()))
    found = _candidate(MAGIC.encode().join(value for _, value in order)) or {}
    return pa.table(
        {
            "file": [key[0].as_py()],
            "record": pa.array([key[1].as_py()], pa.int64()),
            "joined_bytes": pa.array([found.get("payload_bytes")], pa.int64()),
            "joined_digest": pa.array([found.get("payload_digest")], pa.string()),
        }
    )


def _reassembled(spark, path, placed, kept, split) -> DataFrame:
    """Records whose payload holds the magic: their pieces read again, joined, and digested; a record a task."""
    longs = broadcast_if_small(
        split.select(F.col("file").alias("f"), F.col("start").alias("record"), F.col("next").alias("to"))
    )
    inside = placed.join(
        longs, (F.col("file") == F.col("f")) & (F.col("start") >= F.col("record")) & (F.col("start") < F.col("to"))
    ).select("file", "block", "rel", "start", "record")
    texts = _scan(spark, path).mapInArrow(_pieces_of, "file string, block long, rel long, value binary")
    whole = (
        texts.join(broadcast_if_small(stored(inside, "warc-pieces")), ["file", "block", "rel"])
        .groupBy("file", "record")
        .applyInArrow(_joined_payload, "file string, record long, joined_bytes long, joined_digest string")
    )
    broken = kept.where("not whole").drop("payload_bytes", "payload_digest")
    return (
        broken.join(whole.withColumnRenamed("record", "start"), ["file", "start"], "left")
        .withColumnRenamed("joined_bytes", "payload_bytes")
        .withColumnRenamed("joined_digest", "payload_digest")
        .select(*kept.columns)
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and return what reading it back gives."""
    path = shared_path(pages, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path)
