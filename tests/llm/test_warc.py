"""Archives: exact round trips, verification of segments, revisits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from logtable.llm import warc
from logtable.session import shared_dir

SHAPE = "page_id bigint, url string, html string"


def archive(spark, rows, **options):
    path = shared_dir(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, SHAPE), path, **options)
    return warc.read_archive(spark, path)


def test_segments_chunks_and_revisits_come_back(spark):
    same, short = "same é " * 400, "short"
    rows = [
        (1, "http://a/1", same),
        (2, "http://a/2\r\nX: y", same),
        (3, None, short),
        (4, "u", short),
        (5, "u", None),
        (6, "u", ""),
        (7, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n" * 30_000 + "é"),
        (None, "u", same),
        (2, "u", same),
        (8, "u", "x" * 1000),
        (9, "u", "y" * 999),
        (10, "u", "y" * 999),
    ]
    found = archive(spark, rows, segment_bytes=1001, chunk_bytes=97).collect()
    assert all(r.damage is None for r in found)
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found))
    expect = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = raw == same.encode() and page != 2
        digest = hashlib.sha1(raw).hexdigest()
        expect.append((page is None, page or 0, len(raw), digest, "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(expect)
    for r in found:
        if r.record_type == "response":
            assert r.payload.decode() in {html or "" for page, _, html in rows if page == r.page_id}


def test_damaged_segments_are_named(spark):
    path = shared_dir(spark, "warc-test")
    rows = [(1, "u", "a" * 5000), (2, "u", "b" * 5000), (3, "u", "c" * 5000)]
    warc.write_archive(spark.createDataFrame(rows, SHAPE), path, segment_bytes=1000)
    segments = warc._scan(spark.read.format("binaryFile").load(path).select("content"), True)
    assert segments.count() == 18
    lost = ~((F.col("page_id") == 1) & (F.col("number") == 3))
    wrong = F.when(F.col("page_id") == 2, F.col("total") - 1).otherwise(F.col("total"))
    found = {r.page_id: r for r in warc.reassemble(segments.filter(lost).withColumn("total", wrong)).collect()}
    assert found[1].payload is None and "missing" in found[1].damage
    assert found[2].payload is None and "length" in found[2].damage
    assert found[3].payload == b"c" * 5000 and found[3].damage is None


@pytest.mark.parametrize("body", [b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc"])
def test_broken_framing_is_refused(body):
    with pytest.raises(ValueError):
        warc.chunk_unframed(body)


def test_no_pages_and_clashing_columns(spark):
    assert archive(spark, []).count() == 0
    pages = spark.createDataFrame([(1, "u", "h")], SHAPE)
    for name in ("payload", "digest", "bytes", "kept", "n", "refers_to"):
        pages = pages.withColumn(name, F.lit("z"))
    path = shared_dir(spark, "warc-test")
    warc.write_archive(pages, path)
    assert warc.read_archive(spark, path).first().payload == b"h"
