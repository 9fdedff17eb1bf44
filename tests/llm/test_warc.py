import base64
import hashlib

import pytest

from textanomaly.llm import warc


def expected(pages):
    by_payload = {}
    for page_id, _, html in pages:
        by_payload.setdefault((html or "").encode(), []).append(page_id)
    rows = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        known = [i for i in by_payload[data] if i is not None]
        head = max(known) if known else None
        revisit = head is not None and page_id != head
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((page_id, len(data), digest, "revisit" if revisit else "response", head if revisit else None))
    return sorted(rows, key=repr)


def got(df):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/1", "one\r\n\r\ntwo"),
    (2, "http://a/2", "same ü"),
    (3, "http://a/3", "same ü"),
    (3, "http://a/3", "same ü"),
    (4, None, None),
    (5, "http://a/5\r\nX: y", ""),
    (6, "u", "before " + FAKE + "after" + FAKE),
    (7, "u", FAKE),
    (8, "u", "WARC/1.1\r\n"),
    (None, "u", "same ü"),
    (None, "u", "alone"),
    (9, "u", "x" * 300_000 + "WARC/1.1\r\nContent-Length: 9\r\n\r\n"),
]


@pytest.mark.parametrize("split", ["128m", "300"])
def test_round_trip_rejects_magic_inside_payloads(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pages = spark.createDataFrame(
            [(*p, "z", "k") for p in PAGES], "page_id long, url string, html string, digest string, kind string"
        )
        rows = PAGES if split == "128m" else PAGES[:9]
        result = warc.round_trip(pages if split == "128m" else pages.where("page_id < 9 or page_id is null").where("html <> 'alone' or html is null"))
        if split == "300":
            rows = [p for p in PAGES if p[2] != "alone" and p[0] != 9]
        assert got(result) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=3).collect()} == {"response"}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).collect() == []
