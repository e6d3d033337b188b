"""Web archives as tables of record chunks, written and read back as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import cut

#: Payload bytes in one chunk row.
CHUNK_BYTES = 256 << 10
#: Equal payloads of at least this many bytes are stored once; the later ones become revisits.
MIN_REVISIT_BYTES = 100

CHUNKS = "record_id string, serial long, chunk_no int, last boolean, block binary, digest string"
_SCHEMA = pa.schema([("record_id", pa.string()), ("serial", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("block", pa.binary()), ("digest", pa.string())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
#: The head of the archived HTTP message; what follows its blank line is the payload.
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _head(kind: str, page_id: int, url: str | None, date: str, length: int, digest: str, refers_to: int | None) -> bytes:
    body = len(_HTTP) + (length if kind == "response" else 0)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(length)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(body)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + _HTTP


def assign_types(pages: DataFrame) -> DataFrame:
    """Append payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    Of equal payloads of at least MIN_REVISIT_BYTES the one of smallest page_id is a response, the others revisit it; rows
    with that page_id and payload are responses too, and so are rows without page_id. Null html is an empty payload.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keys = cut(page.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest")), "payload-keys")
    large = keys.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    # only digests that occur on more than one page need a place in the join
    shared = cut(large.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared-payloads")
    copies = large.join(shared, "payload_digest").filter(F.col("page_id") != F.col("first_page")).select("page_id", "payload_digest", "first_page").distinct()
    # a page_id may stand with several payloads, each a record of its own
    own = page.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    return own.join(copies, ["page_id", "payload_digest"], "left").select(
        "page_id", "url", "html",
        F.octet_length("html").cast("long").alias("payload_bytes"), "payload_digest",
        F.when(F.col("first_page").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first_page").alias("refers_to"),
    )


def _writer(chunk_bytes: int, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk rows of records. A digest is the SHA-256 of the record's payload up to and including its chunk."""
        out: list[tuple] = []
        size, serial = 0, TaskContext.get().partitionId() << 40
        for b in batches:
            ids, urls, payloads, digests, kinds, refers = (b.column(b.schema.get_field_index(n)) for n in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))
            for i in range(b.num_rows):
                page_id, kind = ids[i].as_py(), kinds[i].as_py()
                payload = memoryview(payloads[i].as_buffer() or b"")
                head = _head(kind, page_id, urls[i].as_py(), date, len(payload), digests[i].as_py(), refers[i].as_py())
                if kind == "revisit":
                    payload = payload[:0]
                running, name, serial = hashlib.sha256(), record_id(page_id), serial + 1
                for n, at in enumerate(range(0, max(1, len(payload)), chunk_bytes)):
                    piece = payload[at : at + chunk_bytes]
                    running.update(piece)
                    last = at + chunk_bytes >= len(payload)
                    block = (head if n == 0 else b"") + bytes(piece) + (b"\r\n\r\n" if last else b"")
                    out.append((name, serial, n, last, block, running.hexdigest()))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def write_archive(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> DataFrame:
    """Write one WARC record per page and return the written chunk table (record_id, serial, chunk_no, last,
    block, digest). serial tells apart the records of pages that have the same page_id.

    The blocks of a record in chunk order are its bytes: header, HTTP head, payload, closing blank lines. A row
    holds chunk_bytes of payload at most, so neither writer nor reader needs a buffer as large as a record.
    date is every record's WARC-Date; without it, that of the call. Repeated pages get records of their own; one without page_id is a response. Null html is an empty payload; no
    pages give no records; other columns are ignored.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    typed = assign_types(pages).withColumn("payload", F.col("html").cast("binary")).drop("html", "payload_bytes")
    return cut(typed.mapInArrow(_writer(chunk_bytes, date), CHUNKS), "archive")


class _Reader:
    """Reads the chunk rows of records one after another; holds a header and the state of a digest, no payload."""

    def __init__(self):
        self.serial = None

    def feed(self, serial: int, number: int, last: bool, block, digest: str) -> tuple | None:
        block = memoryview(block)
        if number == 0:
            head, _, _ = bytes(block).partition(b"\r\n\r\n")  # the first chunk holds the header, however long
            lines = head.decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            at = len(head) + 4 + len(_HTTP)
            self.fine = lines[0] == "WARC/1.1" and bytes(block[at - len(_HTTP) : at]) == _HTTP
            self.running, self.length, self.serial, self.next = hashlib.sha256(), 0, serial, 0
            block = block[at:]
        if last:
            self.fine &= bytes(block[-4:]) == b"\r\n\r\n"
            block = block[:-4]
        self.running.update(block)
        self.length += len(block)
        self.fine &= self.serial == serial and self.next == number and self.running.hexdigest() == digest
        self.next = number + 1
        if not last:
            return None
        f = self.fields
        kind, length = f["WARC-Type"], int(f["WARC-Payload-Length"])
        self.fine &= int(f["Content-Length"]) == len(_HTTP) + self.length
        own = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response":
            self.fine &= (self.length, self.running.hexdigest()) == (length, own)
        page = lambda x: int(n) if (n := x.removeprefix("<urn:page:").rstrip(">")) else None
        return page(f["WARC-Record-ID"]), length, own, kind, page(f["WARC-Refers-To"]) if kind == "revisit" else None, self.fine


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
    for b in batches:
        columns = [b.column(b.schema.get_field_index(n)) for n in _SCHEMA.names]
        rows = []
        for i in range(b.num_rows):
            _, serial, number, last, block, digest = (c[i] for c in columns)
            done = reader.feed(serial.as_py(), number.as_py(), last.as_py(), block.as_buffer(), digest.as_py())
            if done:
                rows.append(done)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_archive(chunks: DataFrame) -> DataFrame:
    """Parse the records of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Digests and lengths are checked chunk by chunk; intact tells whether all agree. A record of one chunk is read
    where it lies; only the chunks of longer ones are brought together, and streamed in order through the digest.
    """
    single = (F.col("chunk_no") == 0) & F.col("last")
    long_ones = chunks.filter(~single).repartition("serial").sortWithinPartitions("serial", "chunk_no")
    return chunks.filter(single).mapInArrow(_read, RECORDS).unionByName(long_ones.mapInArrow(_read, RECORDS))


def archive_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the pages as archives, read those back, and fail if a record isn't what was written."""
    records = read_archive(write_archive(pages, chunk_bytes))
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    return records.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


def record_payloads(chunks: DataFrame) -> DataFrame:
    """Chunk rows with the payload bytes alone and their offset in the record's payload, headers and ends cut off.

    A revisit has one row with no bytes; no records give no rows.
    """
    head = F.expr("locate('\r\n\r\n', decode(block, 'ISO-8859-1'))") + 3 + len(_HTTP)
    start = F.when(F.col("chunk_no") == 0, head).otherwise(F.lit(0))
    size = F.octet_length("block") - start - F.when(F.col("last"), 4).otherwise(0)
    before = Window.partitionBy("serial").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    cutout = chunks.select("record_id", "serial", "chunk_no", F.substring(F.col("block"), start + 1, size).alias("payload"))
    return cutout.withColumn("offset", F.coalesce(F.sum(F.octet_length("payload")).over(before), F.lit(0)))
