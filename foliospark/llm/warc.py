"""Web archives: a writer of gzip-member WARC files and a splittable reader.

Archives live below the shared folder and are opened through ``pyarrow.fs``, so any store
that it knows serves. Every record is a gzip member of its own. A reading task scans a byte
range for gzip magic, accepts a candidate only when its header decodes to a WARC version
line, and owns the records that start inside its range, reading past its end for the last.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, durable, parallelism

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 64_000_000, 8_000_000, 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: names records after pages, so ids need no state and survive retried tasks.
RECORD_URN = "urn:page:"


# -- writing ---------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit carries the digest but no payload."""
    name = lambda k: f"<{RECORD_URN}{'' if k is None else k}>"
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if revisit:
        head += [f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of ``pages``; returns the manifest ``(path, bytes, records)``.

    Of records with equal payloads of ``LEAST_REVISIT`` bytes or more the smallest id is the
    response and the others revisit it. A task writes files under names of its own attempt
    and the manifest lists those of the attempts that counted, so lost executors leave at
    most files that nobody reads. Null html: an empty payload. Null id: after all ids.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_ = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    copies = long_.groupBy("digest").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(copies.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.coalesce("id", F.lit(NULL_ID)) != F.col("first"))
    rows = rows.select("id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, held, count, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "first"))):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    store.create_dir(base, recursive=True)
                    out, held, count = store.open_output_stream(path, compression=None), 0, 0
                data = record(page_id, url, html.encode(), digest, first, first is not None)
                out.write(data)
                held, count = held + len(data), count + 1
                if held >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, held, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, held, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return durable(rows.mapInArrow(run, "path string, bytes long, records long"))


# -- reading ---------------------------------------------------------------------------------


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a decoded record."""
    end = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, data[end + 4 : end + 4 + int(fields["content-length"])]


def _opens(data: bytes) -> bool | None:
    """Whether a WARC record's gzip member starts ``data``; None: too few bytes to tell."""
    try:
        head = zlib.decompressobj(31).decompress(data, len(VERSION))
    except zlib.error:
        return False
    return None if len(head) < len(VERSION) and VERSION.startswith(head) else head == VERSION


def members(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded records that start in ``[start, end)`` of an archive of ``size`` bytes."""
    source.seek(start)
    buffer, base, read_to = b"", start, start  # buffer[0] is byte base of the file

    def more() -> bool:
        nonlocal buffer, read_to
        data = source.read(min(READ_BYTES, size - read_to))
        read_to += len(data)
        buffer += data
        return bool(data)

    while True:
        at = buffer.find(MAGIC)
        while at < 0:
            drop = max(0, len(buffer) - len(MAGIC) + 1)
            buffer, base = buffer[drop:], base + drop
            if base >= end or not more():
                return
            at = buffer.find(MAGIC)
        buffer, base = buffer[at:], base + at
        if base >= end:
            return
        while (opens := _opens(buffer)) is None and more():
            pass
        if not opens:
            buffer, base = buffer[1:], base + 1
            continue
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(buffer))
            base += len(buffer) - len(unpack.unused_data)
            buffer = unpack.unused_data
            if unpack.eof or not more():
                break
        if not unpack.eof:
            raise ValueError(f"a record is cut off at byte {base}")
        yield b"".join(parts)


def page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(RECORD_URN)
    return int(number) if number else None


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest(path, bytes)``, by byte ranges.

    Columns: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and with
    ``with_payload`` the payload. Responses are measured and digested as read, and must have
    the digest their header states; revisits state those of the full payload.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(parallelism(spark), 1), "path", "start")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                rows: list[tuple] = []
                with store.open_input_file(path) as source:
                    for data in members(source, start, min(start + range_bytes, size), size):
                        fields, block = parse(data)
                        kind = fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        length, payload = int(fields["warc-payload-length"]), None
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            length = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the payload of {fields['warc-record-id']} is damaged")
                        url = fields.get("warc-target-uri")
                        row = (page_of(fields["warc-record-id"]), None if url is None else unquote(url), length, digest, kind, page_of(fields.get("warc-refers-to")))
                        rows.append((*row, payload) if with_payload else row)
                        if len(rows) >= 500:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ranges.mapInArrow(run, schema)


#: DuckDB SQL for the query over ``pages``.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
