"""Web archives (WARC/1.1, one gzip member per record), written and read in chunks.

Payloads become (record, chunk number) rows before they reach the writer, and
the reader gives such rows back, each with its offset and the SHA-1 of the
payload up to and including it, so the last chunk carries the digest of the
whole. No task builds a whole record: the writer compresses chunk by chunk, the
reader decompresses, parses and hashes chunk by chunk.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest id is written in full (``response``); the others are ``revisit`` records
that name it and hold only the HTTP header. Which is which comes from one
aggregate of (digest, id); payloads are not shuffled unless the groups of copies
outgrow a broadcast.

Each writer task names its files anew, and only files that a finished task
reported are read: tasks may be repeated. The reported spans are the units of
reading, so a large archive is read by many tasks.

Defined cases: a null payload is empty; a null id or address is read back as
null; rows with the largest id of a group are all responses; an empty table
gives an empty archive; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid.session import broadcast_if_small, materialize, scratch_path

# Names and marks of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE16_TO_32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
END = b"\r\n\r\n"

CHUNK_BYTES = 1 << 16
READ_CHUNK_BYTES = 1 << 20
SPAN_BYTES = 4 << 20
FILE_BYTES = 256 << 20
ROWS_OUT = 2_000
BYTES_OUT = 4 << 20
BROADCAST_GROUPS = 500_000
DATE = "1970-01-01T00:00:00Z"
SPANS = "path string, start bigint, size bigint, records bigint"
CHUNKS = (
    "record_id bigint, url string, record_type string, refers_to bigint, chunk_no int, offset bigint, data binary, "
    "payload_bytes bigint, payload_digest string, declared_digest string, is_last boolean"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, by built-in functions: 40 bits are 10 hex or 8 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *BASE16_TO_32)


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """record_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    records = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url).alias("url"), body.alias("payload")).withColumns(
        {"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    groups = records.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.max("record_id").alias("keeper"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").drop("copies")
    joined = records.join(broadcast_if_small(materialize(groups, "copies"), BROADCAST_GROUPS), "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("keeper"))
    return joined.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("keeper")),
    }).drop("keeper")


def payload_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, a record's chunks in order; revisits and empty payloads have one empty chunk."""
    sent = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    last = F.greatest(F.ceil(sent / chunk_bytes) - 1, F.lit(0)).cast("int")
    data = F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return records.withColumn("last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), "last"))).select(
        "record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes",
        (F.col("chunk_no") == 0).alias("is_first"), (F.col("chunk_no") == F.col("last")).alias("is_last"),
        F.when(F.col("record_type") == "response", data).otherwise(F.lit(b"")).alias("data"),
    )


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def _head(record_id, url, kind, refers_to, digest, payload_bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    length = len(http) + (payload_bytes if kind == "response" else 0)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END + http


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows as archives under ``folder``; gives the spans (path, start, size, records) to read.

    The result is stored: each of its rows stands for bytes that are on disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, written, spans, press = None, "", 0, [], None
        start = records = 0

        def close_span() -> None:
            nonlocal start, records
            if records:
                spans.append((f"{folder.rstrip('/')}/{name}", start, written - start, records))
            start, records = written, 0

        for batch in batches:
            for row in batch.to_pylist():
                if row["is_first"]:
                    if out is None:
                        name, written, start = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    written += out.write(press.compress(_head(*(row[c] for c in (
                        "record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")))))
                written += out.write(press.compress(row["data"]))
                if row["is_last"]:
                    written += out.write(press.compress(END) + press.flush())
                    records += 1
                    if written - start >= SPAN_BYTES:
                        close_span()
                    if written >= FILE_BYTES:
                        close_span()
                        out.close()
                        out = None
        if out is not None:
            close_span()
            out.close()
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*spans)], ["path", "start", "size", "records"])

    return materialize(chunks.mapInArrow(run, SPANS), "spans")


def _decompressed(file, size: int) -> Iterator[tuple[bool, bytes]]:
    """(first of a member, bytes) over all gzip members in the next ``size`` bytes."""
    left, data = size, b""
    while left or data:
        member, first = zlib.decompressobj(31), True
        while not member.eof:
            piece = member.decompress(data, CHUNK_BYTES)
            data = member.unused_data if member.eof else member.unconsumed_tail
            if piece or (first and member.eof):
                yield first, piece
                first = False
            elif not data and not member.eof:
                data = file.read(min(CHUNK_BYTES, left))
                if not data:
                    raise EOFError("an archive ends inside a record")
                left -= len(data)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {pair[0]: pair[1] for pair in pairs if len(pair) == 2}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


class _Record:
    """Takes the bytes of one record and gives its chunk rows."""

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.chunk_bytes, self.with_data = chunk_bytes, with_data
        self.fields = self.http = None
        self.waiting, self.left, self.offset, self.chunk_no = bytearray(), 0, 0, 0
        self.digest = hashlib.sha1()

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.waiting += data
        if self.fields is None and END in self.waiting:
            head, _, rest = bytes(self.waiting).partition(END)
            if not head.startswith(VERSION):
                raise ValueError("not a WARC record")
            self.fields, self.waiting = _fields(head), bytearray(rest)
            self.left = int(self.fields["Content-Length"])
        if self.fields is not None and self.http is None and END in self.waiting:
            head, _, rest = bytes(self.waiting).partition(END)
            self.http, self.waiting = _fields(head), bytearray(rest)
            self.left -= len(head) + len(END)
        if self.http is not None:
            while self.left > self.chunk_bytes <= len(self.waiting):
                yield self._row(self.chunk_bytes)

    def _row(self, size: int) -> tuple:
        data = bytes(self.waiting[:size])
        del self.waiting[:size]
        self.left -= size
        self.digest.update(data)
        self.offset += size
        fields, revisit = self.fields, self.fields["WARC-Type"] == "revisit"
        declared = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        own = declared if revisit else base64.b32encode(self.digest.copy().digest()).decode()
        url = fields.get("WARC-Target-URI")
        row = (
            _number(fields["WARC-Record-ID"]), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), self.chunk_no, self.offset - size,
            data if self.with_data and not revisit else None, int(self.http["Content-Length"]) if revisit else self.offset,
            own, declared, self.left == 0,
        )
        self.chunk_no += 1
        return row

    def finish(self) -> tuple:
        if self.http is None or len(self.waiting) != self.left + len(END):
            raise EOFError("an archive ends inside a record")
        return self._row(self.left)


def read_archives(spans: DataFrame, chunk_bytes: int = READ_CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of all records: see ``CHUNKS``. A revisit is one row without data and with the size and digest of what it refers to.

    payload_bytes and payload_digest cover the payload up to the end of the chunk.
    """
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for span in batch.to_pylist():
                files, path = _filesystem(span["path"])
                with files.open_input_file(path) as file:
                    file.seek(span["start"])
                    record = None
                    for first, data in _decompressed(file, span["size"]):
                        if first:
                            if record:
                                rows.append(record.finish())
                            record = _Record(chunk_bytes, with_data)
                        rows += record.feed(data)
                        held += len(data)
                        if len(rows) >= ROWS_OUT or (rows and held >= BYTES_OUT):
                            yield pack(rows)
                            rows, held = [], 0
                    if record:
                        rows.append(record.finish())
        if rows:
            yield pack(rows)

    tasks = max(1, int(spans.sparkSession.sparkContext.defaultParallelism))
    return spans.repartition(max(tasks, spans.rdd.getNumPartitions())).mapInArrow(run, CHUNKS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, with_data: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to new archives in the shared folder and read them back as chunk rows."""
    spans = write_archives(payload_chunks(plan_records(pages, min_bytes=min_bytes)), scratch_path(spark, "warc"))
    return read_archives(spans, with_data=with_data)
