"""Web archives: WARC 1.1 files written by Spark tasks and read back, segments put together again.

``write_archive`` stores one record per page. The payload (the page's html in UTF-8) travels as an HTTP
response in chunked transfer framing. A block longer than ``segment_bytes`` becomes a first segment and
``continuation`` records. Of equal payloads of at least ``revisit_from`` bytes the one with the largest
page id is the response and the others are revisits without a payload.

``read_archive`` parses the files, groups the segments of a record by their origin, orders them by segment
number, verifies numbers and total length, and takes the chunk framing off. A record that fails
verification comes back with a null payload and the reason in ``damage``.

The files are gzipped Spark text output whose line separator is the blank line pair that ends a WARC record, so
they are committed task by task and can lie in any store that Spark reaches.

Defined cases: null html is an empty payload; a null page id is kept, never refers to itself and is never
the largest unless all are null; a repeated row with the largest page id is a response too; a null url
leaves out the target header, and characters that can't stand in a header are percent-encoded. No rows
give an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF, END = b"\r\n", b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"
NO_PAGE = "none"
SEGMENT = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, damage string, capture string, number int, total bigint"


def chunk_framed(payload: bytes, chunk_bytes: int) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk_bytes):
        chunk = payload[at : at + chunk_bytes]
        parts += (b"%x\r\n" % len(chunk), chunk, CRLF)
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def chunk_unframed(body: bytes) -> bytes:
    """The payload in a chunked body. Raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _head(fields: list[tuple[bytes, bytes]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % f for f in fields) + CRLF


def _records(page_id, url, payload: bytes, digest: str, refers_to, capture: str, segment_bytes: int, chunk_bytes: int):
    """The records of one page, each without the blank lines that end it."""
    name = b"<urn:page:%s>" % str(NO_PAGE if page_id is None else page_id).encode()
    common = [(b"WARC-Date", DATE), (b"X-Capture", capture.encode())]
    if url is not None:
        common.append((b"WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~").encode()))
    common.append((b"WARC-Payload-Digest", b"sha1:" + digest.encode()))
    kind = b"response" if refers_to is None else b"revisit"
    own = [(b"WARC-Type", kind), (b"WARC-Record-ID", name), (b"Content-Type", b"application/http; msgtype=response")]
    if refers_to is not None:
        own += [
            (b"WARC-Profile", PROFILE),
            (b"WARC-Refers-To", b"<urn:page:%d>" % refers_to),
            (b"X-Payload-Length", b"%d" % len(payload)),
        ]
        return [_head(own + common + [(b"Content-Length", b"%d" % len(HTTP))]) + HTTP]
    block = HTTP + chunk_framed(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_head(own + common + [(b"Content-Length", b"%d" % len(block))]) + block]
    out = []
    for number, at in enumerate(range(0, len(block), segment_bytes), 1):
        piece = block[at : at + segment_bytes]
        fields = own + common if number == 1 else [
            (b"WARC-Type", b"continuation"),
            (b"WARC-Record-ID", name[:-1] + b":%d>" % number),
            (b"WARC-Segment-Origin-ID", name),
            *common,
        ]
        fields = [*fields, (b"WARC-Segment-Number", b"%d" % number)]
        if at + segment_bytes >= len(block):
            fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_head([*fields, (b"Content-Length", b"%d" % len(piece))]) + piece)
    return out


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    revisit_from: int = 1000,
    segment_bytes: int = 64 * 1024,
    chunk_bytes: int = 16 * 1024,
    records_per_file: int = 1000,
) -> None:
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    # only payloads that occur more than once: few rows of no content, whatever the pages hold
    shared = (
        rows.filter(F.col("bytes") >= revisit_from)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .filter("n > 1 and kept is not null")
        .select("digest", "bytes", "kept")
    )
    marked = rows.join(shared, ["digest", "bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")), F.col("kept")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                out += _records(*row, f"{task}.{seen}", segment_bytes, chunk_bytes)
                seen += 1
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    # the text sink writes the bytes of a string as they are
    lines = marked.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(
        path, compression="gzip"
    )


def _page(name: bytes | None) -> int | None:
    if name is None:
        return None
    text = name[len(b"<urn:page:") : -1].decode()
    return None if text == NO_PAGE else int(text)


def _opened(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP response block, or why there is none."""
    try:
        return chunk_unframed(block[block.index(END) + 4 :]), None
    except ValueError as broken:
        return None, str(broken)


def _parsed(content: bytes, segments: bool) -> Iterator[tuple]:
    """The rows (SEGMENT) of one file: its whole records, or only its segments with their raw blocks."""
    at = 0
    while at < len(content):
        head_end = content.index(END, at)
        head = dict(line.split(b": ", 1) for line in content[at:head_end].split(CRLF)[1:])
        start = head_end + 4
        at = start + int(head[b"Content-Length"]) + 4
        number = head.get(b"WARC-Segment-Number")
        if (number is not None) != segments:
            continue
        block, kind = content[start : at - 4], head[b"WARC-Type"].decode()
        digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        origin, capture = head.get(b"WARC-Segment-Origin-ID", head[b"WARC-Record-ID"]), head[b"X-Capture"].decode()
        if segments:
            total = head.get(b"WARC-Segment-Total-Length")
            yield _page(origin), kind, None, None, digest, block, None, capture, int(number), None if total is None else int(total)
        elif kind == "revisit":
            yield _page(origin), kind, _page(head[b"WARC-Refers-To"]), int(head[b"X-Payload-Length"]), digest, None, None, capture, 1, None
        else:
            payload, damage = _opened(block)
            yield _page(origin), kind, None, None if payload is None else len(payload), digest, payload, damage, capture, 1, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("payload", pa.binary()), ("damage", pa.string()), ("capture", pa.string()),
     ("number", pa.int32()), ("total", pa.int64())]
)


def _scan(files: DataFrame, segments: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _batch(list(_parsed(gzip.decompress(content.as_py()), segments)), _ARROW)

    return files.mapInArrow(scan, SEGMENT)


def reassemble(segments: DataFrame) -> DataFrame:
    """Rows of segments -> one row per record: ordered, verified, unframed."""
    one = F.struct("number", "total", "record_type", "payload_digest", F.col("payload").alias("block"))
    groups = segments.groupBy("page_id", "capture").agg(F.array_sort(F.collect_list(one)).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, capture, parts in zip(*(c.to_pylist() for c in batch.columns)):
                block = b"".join(p["block"] for p in parts)
                last = parts[-1]
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or last["total"] is None:
                    payload, damage = None, "segments are missing or repeated"
                elif last["total"] != len(block):
                    payload, damage = None, "total length does not match"
                else:
                    payload, damage = _opened(block)
                size = None if payload is None else len(payload)
                first = parts[0]
                row = (page_id, first["record_type"], None, size, first["payload_digest"], payload, damage, capture, 1, None)
                yield _batch([row], _ARROW)

    return groups.select("page_id", "capture", "parts").mapInArrow(join, SEGMENT)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload_bytes, payload_digest, payload, damage`` of every record.

    The digest of a response is taken from the payload read, that of a revisit from its header.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = _scan(files, False).unionByName(reassemble(_scan(files, True)))
    return found.select(
        "page_id",
        "record_type",
        "refers_to",
        "payload_bytes",
        F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "payload",
        F.when(
            F.col("damage").isNull() & F.col("payload").isNotNull() & (F.sha1("payload") != F.col("payload_digest")),
            F.lit("digest does not match"),
        ).otherwise(F.col("damage")).alias("damage"),
    )
