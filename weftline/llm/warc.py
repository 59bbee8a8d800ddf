"""WARC files written and read as chunk tables.

A record is read as rows (record, chunk number): each chunk holds at most CHUNK bytes of the block and the digest of the
payload up to its end, carried forward from chunk to chunk, so that no task ever holds a whole record. The last chunk
of a record has the payload's whole length and digest. Archives are gzip files with a member for each record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._shared import fresh_dir, lean, open_new, open_old, written

CHUNK = 1 << 20
FILE = 256 << 20
LEVEL = 4
#: The date that records carry unless the caller gives another; it keeps a task that is run again from writing other bytes.
DATE = "2024-01-01T00:00:00Z"
# fixed value of the format
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


class WarcWriter:
    """Writes records to an open file, each as a gzip member, in pieces of at most CHUNK bytes."""

    def __init__(self, out: IO[bytes], level: int = LEVEL) -> None:
        self.out, self.level, self.bytes = out, level, 0

    def add(self, headers: list[tuple[str, str]], block: list[bytes | memoryview]) -> None:
        size = sum(map(len, block))
        head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(size))]) + "\r\n"
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(packer.compress(head.encode()))
        for part in block:
            for at in range(0, len(part), CHUNK):
                self._put(packer.compress(part[at : at + CHUNK]))
        self._put(packer.compress(b"\r\n\r\n") + packer.flush())

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


class _Plain:
    """The decompressed bytes of a file of gzip members (or of a plain file), read in bounded pieces."""

    def __init__(self, f: IO[bytes], piece: int = 256 << 10) -> None:
        self.f, self.piece, self.held, self.packer, self.rest, self.ended = f, piece, b"", None, b"", False
        start = f.read(2)
        f.seek(0)
        self.gzip = start == b"\x1f\x8b"

    def _more(self) -> bool:
        if self.ended:
            return False
        if not self.gzip:
            raw = self.f.read(self.piece)
            self.ended = not raw
            self.held += raw
            return bool(raw)
        while True:
            if not self.rest:
                self.rest = self.f.read(self.piece)
                if not self.rest:
                    self.ended = True
                    if self.packer is not None:
                        raise ValueError("the archive ends within a gzip member")
                    return False
            if self.packer is None:
                self.packer = zlib.decompressobj(31)
            out = self.packer.decompress(self.rest, self.piece)
            if self.packer.eof:
                self.rest, self.packer = self.packer.unused_data, None
            else:
                self.rest = self.packer.unconsumed_tail
            if out:
                self.held += out
                return True

    def line(self) -> bytes | None:
        """Up to the next line feed, which it includes; None at the end."""
        while b"\n" not in self.held:
            if not self._more():
                out, self.held = self.held, b""
                return out or None
        at = self.held.index(b"\n") + 1
        out, self.held = self.held[:at], self.held[at:]
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        if len(out) < n:
            raise ValueError("the archive ends within a record")
        return out


def _headers(plain: _Plain) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := plain.line()) not in (None, b"\r\n", b"\n"):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class Chunk:
    """A piece of a record's payload; `digest` covers the payload up to its end, `last` marks the record's last chunk."""

    __slots__ = ("headers", "http", "number", "offset", "payload", "digest", "last")

    def __init__(self, headers, http, number, offset, payload, digest, last) -> None:
        self.headers, self.http, self.number, self.offset, self.payload, self.digest, self.last = headers, http, number, offset, payload, digest, last


def read_chunks(f: IO[bytes], size: int = CHUNK) -> Iterator[Chunk]:
    """The records of an archive, chunk by chunk. The payload of a record with an HTTP block is its body; of others, the block."""
    plain = _Plain(f)
    while (line := plain.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _headers(plain)
        left = int(headers["content-length"])
        http: dict[str, str] = {}
        if headers.get("content-type", "").startswith("application/http"):
            before = left
            status = plain.line() or b""
            left -= len(status)
            while left > 0:
                line = plain.line() or b""
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
                key, _, value = line.decode("utf-8", "replace").partition(":")
                http[key.strip().lower()] = value.strip()
            if left < 0:
                raise ValueError(f"an HTTP head is longer than its block of {before} bytes")
        sha, number, offset = hashlib.sha1(), 0, 0
        while True:
            part = plain.read(min(size, left))
            left -= len(part)
            sha.update(part)
            yield Chunk(headers, http, number, offset, part, digest32(sha.digest()), not left)
            number, offset = number + 1, offset + len(part)
            if not left:
                break


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE, file_bytes: int = FILE) -> DataFrame:
    """Writes a record for each row and returns the written files' table (path, n_records, n_bytes).

    Among rows of equal payloads of at least `least` bytes, those of the largest id are responses and the others revisit
    records that refer to it; rows of smaller payloads are all responses. A revisit has the HTTP head, with the length of
    the payload, and the payload's digest, but not the payload. A null payload is an empty one; a null url is written as
    urn:record:<id>. Null ids are smaller than all others: they are revisits unless no row of their payload has an id.
    A repeated row of the largest id is a response each time. Other columns are not read; an empty table writes nothing.
    """
    folder = folder or fresh_dir(df.sparkSession, "warc")
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    seen = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("first")).where("n > 1")
    again = written(seen.select("sha", "first"), "repeated-payloads")
    rows = rows.join(again, "sha", "left").withColumn("first", F.when(F.col("first") != F.coalesce("id", F.col("first") - 1), F.col("first")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def records() -> Iterator[tuple]:
            for batch in batches:
                for at in range(len(batch)):
                    yield tuple(batch.column(c)[at] for c in ("id", "url", "payload", "sha", "first"))

        rows = records()
        one = next(rows, None)
        while one is not None:
            path, n = f"{folder}/{part:06d}-{number:04d}.warc.gz", 0
            with open_new(path) as out:
                writer = WarcWriter(out)
                while one is not None and writer.bytes < file_bytes:
                    writer.add(*_record(*one, date))
                    n += 1
                    one = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([writer.bytes], pa.int64())], ["path", "n_records", "n_bytes"])

    return written(rows.select("id", "url", "payload", "sha", "first").mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-files")


def _record(id_, url, payload, sha, first, date: str) -> tuple[list[tuple[str, str]], list[bytes | memoryview]]:
    id_, url, first = id_.as_py(), url.as_py(), first.as_py()
    body = memoryview(payload.as_buffer())
    target = url if url is not None else f"urn:record:{id_}"
    digest = "sha1:" + digest32(sha.as_py())
    kind = "response" if first is None else "revisit"
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{id_}\n{target}\n{digest}\n{kind}")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if id_ is not None:
        headers.append(("X-Row-ID", str(id_)))
    if first is not None:
        headers += [("WARC-Profile", IDENTICAL), ("X-Refers-To-Row-ID", str(first))]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return headers, [head] if first is not None else [head, body]


CHUNK_TYPE = "path string, record long, chunk int, last boolean, record_id string, record_type string, target_uri string, row_id string, refers_to string, declared_digest string, http_length long, offset long, n_bytes long, digest string"


def chunks(files: DataFrame, size: int = CHUNK, payload: bool = False) -> DataFrame:
    """The chunk table of the archives in column `path`: a row for each record (its number in the file) and chunk number, with
    the SHA-1 (base32) of the payload up to the chunk's end and, if asked for, the chunk's bytes in column payload. Header
    fields that a record lacks are null. A record without payload has one chunk of no bytes. A damaged archive fails the job."""
    schema = CHUNK_TYPE + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), *[pa.string()] * 6, *[pa.int64()] * 3, pa.string(), *[pa.binary()] * payload]

    def rows(path: str) -> Iterator[tuple]:
        with open_old(path) as f:
            record = -1
            for c in read_chunks(f, size):
                record += c.number == 0
                h = c.headers
                length = c.http.get("content-length", "")
                row = (path, record, c.number, c.last, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("x-row-id"), h.get("x-refers-to-row-id"), h.get("warc-payload-digest"), int(length) if length.isdigit() else None, c.offset, len(c.payload), c.digest)
                yield (*row, c.payload) if payload else row

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, weight = [], 0
                for row in rows(path):
                    held.append(row)
                    weight += 200 + payload * row[12]
                    if weight >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, schema)


def records(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each record: its header fields, payload_bytes and payload_digest. Those of a revisit are the ones that it declares;
    a response whose payload hasn't the digest that it declares fails the job."""
    last = chunks(files, size).where("last")
    revisit = F.col("record_type") == "revisit"
    declared = F.element_at(F.split("declared_digest", ":"), -1)
    checked = F.when(declared.isNotNull() & (declared != F.col("digest")), F.raise_error(F.concat(F.lit("wrong digest in record "), F.col("record_id"))).cast(T.StringType())).otherwise(F.col("digest"))
    return last.select("path", "record", "record_id", "record_type", "target_uri", "row_id", "refers_to", F.when(revisit, F.col("http_length")).otherwise(F.col("offset") + F.col("n_bytes")).alias("payload_bytes"), F.when(revisit, declared).otherwise(checked).alias("payload_digest"))
