"""WARC archives as a chunked record table.

A record is written as rows (record_id, chunk, data): the WARC header with the HTTP header, then the payload in pieces of
``CHUNK`` bytes. Laid one after another in the order of (record_id, chunk) the data are a WARC file. Writer and reader
pass a record on piece by piece and carry its SHA-1 along; neither puts a record together.

Of the records with equal payloads one is a response, the others are revisits that refer to it and hold no payload.

Nulls and edges: a null html is an empty payload. A null url has no target line; line ends in urls are percent-encoded. A
null ``page_id`` comes before all others; rows of one ``page_id`` and payload are alike: all of them are responses if their
id is the group's largest. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 64 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest, payload_bytes, record_type and refers_to of every page.

    Among payloads of ``least`` bytes or more the row with the largest page_id is the response of its equals. The winners
    are found from ids and digests alone, with partial maxima before anything is sent.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    best = known.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("best"))
    joined = known.join(best, ["digest", "payload_bytes"], "left")
    first = (F.col("payload_bytes") < least) | F.col("page_id").eqNullSafe(F.col("best"))
    return joined.select("page_id", "url", "html", "digest", "payload_bytes", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("best")).alias("refers_to"))


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def head(page_id, url: str | None, hex_digest: str, size: int, kind: str, refers_to) -> bytes:
    """WARC header and HTTP header of a record; the HTTP header names the size of the full payload for a revisit, too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + _END + http


def write(pages: DataFrame) -> DataFrame:
    """(record_id, chunk, data) of the records of ``kinds``. A record id is the partition's number and a count."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 40
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["record_id", "chunk", "data"])
            rows, held = [], 0

        for batch in batches:
            html = batch.column(2).cast(pa.binary()).fill_null(b"")
            fields = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for i, row in enumerate(zip(*fields, strict=True)):
                rows.append((record, 0, head(*row)))
                chunk = 1
                if row[4] == "response":
                    payload = memoryview(html[i].as_buffer())
                    for at in range(0, len(payload), CHUNK):
                        rows.append((record, chunk, bytes(payload[at : at + CHUNK])))
                        chunk, held = chunk + 1, held + CHUNK
                        if held >= 16 * CHUNK:
                            yield from out()
                rows.append((record, chunk, _END))
                record += 1
            yield from out()

    return pages.select("page_id", "url", "html", "digest", "payload_bytes", "record_type", "refers_to").mapInArrow(step, "record_id long, chunk int, data binary")


class _Record:
    """A record that is being read: its header fields and what its payload has come to."""

    def __init__(self):
        self.header, self.fields, self.sha, self.size, self.left = b"", None, hashlib.sha1(), 0, 0

    def take(self, data: bytes) -> None:
        if self.fields is None:
            self.header += data
            if self.header.count(_END) < 2:
                return
            warc, http, data = self.header.split(_END, 2)
            lines = [x.partition(": ") for x in warc.decode().split("\r\n")[1:]]
            self.fields = {k.lower(): v for k, _, v in lines}
            self.full = int(dict(x.partition(": ")[::2] for x in http.decode().split("\r\n")[1:])["Content-Length"])
            self.left = int(self.fields["content-length"]) - len(http) - len(_END)
        data = data[: self.left]
        self.left -= len(data)
        self.size += len(data)
        self.sha.update(data)

    def row(self) -> tuple:
        kind, digest = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            found = base64.b32encode(self.sha.digest()).decode()
            if self.left or self.size != self.full or found != digest:
                raise ValueError(f"record {self.fields['warc-record-id']} is damaged: {self.size} of {self.full} bytes, digest {found}")
        page = [None if x in (None, "<urn:page:none>") else int(x[10:-1]) for x in (self.fields["warc-record-id"], self.fields.get("warc-refers-to"))]
        return page[0], self.full, digest, kind, page[1]


def read(chunks: DataFrame) -> DataFrame:
    """One row a record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are checked against their digest and length while they stream by.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record = None, None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

        for batch in batches:
            rows = []
            for found, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found != now:
                    rows += [record.row()] if record else []
                    now, record = found, _Record()
                record.take(data.as_py())
            if rows:
                yield done(rows)
        if record:
            yield done([record.row()])

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(n, "record_id").sortWithinPartitions("record_id", "chunk")
    return ordered.select("record_id", "data").mapInArrow(step, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
