"""WARC archives as a chunked record table.

An archive is a table of rows (record_id, chunk_no, last, data, digest_so_far).
Joining the data of a record in chunk order gives the bytes of the WARC record,
and joining records gives a valid WARC file (``export_file`` does). A record
that fits one chunk is one row; an oversized one is streamed as many, each
carrying the SHA-1 of the payload up to it, so neither the writer nor the
reader ever holds more than a chunk beside the row Spark handed over.

Payloads are compared by length and SHA-1. Only digests that occur more than
once are grouped and joined back, pre-aggregated before their shuffle, so a
payload that a third of all pages share costs no more than its rows.

Defined results
    * null html: an empty payload. Empty payloads are equal to each other.
    * of equal payloads the largest page_id is the response. Rows with that same
      id and payload are all responses. A null id is smaller than any other.
    * an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK_BYTES = 256 * 1024
FLUSH_BYTES = 4 * 1024 * 1024
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"

CHUNK_SCHEMA = "record_id string, chunk_no int, last boolean, data binary, digest_so_far string"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, intact boolean"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("data", pa.binary()),
        ("digest_so_far", pa.string()),
    ]
)


def digest_text(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode("ascii")


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def header(record_id, page_id, url, kind, digest, size, refers_to) -> bytes:
    """The head of a record; ``size`` is that of the full payload, also for a revisit."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {refers_to}",
            f"X-Payload-Length: {size}",
            "Content-Length: 0",
        ]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


END = b"\r\n\r\n"


def record_chunks(page_id, url, payload, kind, digest, refers_to, chunk=CHUNK_BYTES):
    """Rows of one record. ``payload`` is any buffer; it is sliced, never copied whole."""
    rid = str(uuid.uuid4())
    head = header(rid, page_id, url, kind, digest, len(payload), refers_to)
    body = memoryview(payload) if kind == "response" else memoryview(b"")
    sha1 = hashlib.sha1()
    if len(head) + len(body) + len(END) <= chunk:
        sha1.update(body)
        yield rid, 0, True, b"".join((head, body, END)), digest_text(sha1)
        return
    yield rid, 0, False, head, digest_text(sha1)
    no = 0
    for lo in range(0, len(body), chunk):
        part = body[lo : lo + chunk]
        sha1.update(part)
        no += 1
        yield rid, no, False, bytes(part), digest_text(sha1)
    yield rid, no + 1, True, END, digest_text(sha1)


def _flushed(rows, schema=_ARROW, size=lambda r: len(r[3]) + 100):
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
                schema=schema,
            )
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
            schema=schema,
        )


def write_archive(
    pages: DataFrame, key="page_id", url="url", html="html", min_bytes=MIN_REVISIT_BYTES
) -> DataFrame:
    """Write one record per row to a chunked record table in the shared folder; returns that table."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    d = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        body.alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    # Only payloads that occur again; partial sums are formed before the shuffle.
    again = (
        d.filter(F.col("size") >= min_bytes)
        .groupBy("sha1", "size")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
        .filter("n > 1")
        .select(F.col("sha1").alias("a_sha1"), F.col("size").alias("a_size"), "keeper")
    )
    again = written(again, "warc-repeats")
    d = d.join(
        again, (F.col("sha1") == F.col("a_sha1")) & (F.col("size") == F.col("a_size")), "left"
    ).select("page_id", "url", "payload", "sha1", "keeper")

    def run(batches):
        def rows():
            for batch in batches:
                ids, urls, bodies, sha1s, keepers = batch.columns
                for i in range(batch.num_rows):
                    page_id, keeper = ids[i].as_py(), keepers[i].as_py()
                    digest = base64.b32encode(bytes.fromhex(sha1s[i].as_py())).decode("ascii")
                    kind = "response" if keeper is None or keeper == page_id else "revisit"
                    payload = bodies[i].as_buffer()
                    yield from record_chunks(page_id, urls[i].as_py(), payload, kind, digest, keeper)

        yield from _flushed(rows())

    return written(d.mapInArrow(run, CHUNK_SCHEMA), "warc-archive")


def parse_head(head: bytes) -> dict:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        if line:
            name, _, value = line.partition(": ")
            out[name.lower()] = value
    return out


def _record(fields: dict, sha1, got: int, chained: bool):
    """The row of a record whose payload bytes were counted and digested while streaming."""
    kind = fields["warc-type"]
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    page_id = fields.get("x-page-id")
    refers = fields.get("x-refers-to-page-id")
    if kind == "revisit":
        size, digest, ok = int(fields["x-payload-length"]), said, got == 0
    else:
        size, digest = got, digest_text(sha1)
        ok = digest == said and got == int(fields["content-length"])
    return (
        None if page_id is None else int(page_id),
        fields.get("warc-target-uri"),
        kind,
        size,
        digest,
        None if refers is None else int(refers),
        ok and chained,
    )


_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("intact", pa.bool_()),
    ]
)


def _read_chunks(batches):
    """Stream chunk rows in (record_id, chunk_no) order into one row per record."""

    def rows():
        fields, sha1, got, pending, chained = None, None, 0, b"", True
        for batch in batches:
            rids, nos, lasts, datas, sofar = batch.columns
            for i in range(batch.num_rows):
                no, last = nos[i].as_py(), lasts[i].as_py()
                data = memoryview(datas[i].as_buffer())
                if no == 0:
                    pending = bytes(data[: 64 * 1024])
                    end = pending.find(END)
                    if end < 0:  # a longer head, which lies in this chunk whole
                        pending = bytes(data)
                        end = pending.index(END)
                    fields, sha1, got, chained = parse_head(pending[:end]), hashlib.sha1(), 0, True
                    data = data[end + len(END) :]
                    left = int(fields["content-length"])
                take = data[: max(0, left - got)]
                sha1.update(take)
                got += len(take)
                chained = chained and digest_text(sha1) == sofar[i].as_py()
                if last:
                    yield _record(fields, sha1, got, chained)

    yield from _flushed(rows(), _RECORD_ARROW, size=lambda r: 200)


def read_archive(archive: DataFrame) -> DataFrame:
    """One row per record. Rows that are whole records are read where they lie; only the
    chunks of oversized records are brought together, by record, and streamed."""
    chunk = archive.select("record_id", "chunk_no", "last", "data", "digest_so_far")
    whole = (F.col("chunk_no") == 0) & F.col("last")
    small = chunk.filter(whole).mapInArrow(_read_chunks, RECORD_SCHEMA)
    large = (
        chunk.filter(~whole)
        .repartition("record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .mapInArrow(_read_chunks, RECORD_SCHEMA)
    )
    return small.unionByName(large)


def export_file(archive: DataFrame, path: str) -> int:
    """Write the records as one .warc file at a path of the caller, row by row; returns its bytes."""
    n = 0
    with open(path, "wb") as f:
        for r in archive.orderBy("record_id", "chunk_no").select("data").toLocalIterator():
            n += f.write(r["data"])
    return n
