"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Each record is one gzip member. The reader streams an archive in pieces of ``PIECE`` bytes, inflates
member by member, reads the header lines, frames the block by ``Content-Length`` and verifies the block
and payload digests. An archive is the unit of work: it is closed at ``ARCHIVE_BYTES``, and each one
is read by one task.

Archives are written from the tasks into a folder that all executors share. Their names carry
the task attempt, and only the paths that a finished attempt returned are in the manifest, so
an attempt that was lost leaves files that nobody reads.

Defined results: a null ``html`` is an empty payload; of equal payloads (of at least ``min_bytes``) the
one with the smallest ``page_id`` is the response (all its rows, if that id is repeated), the others
revisit it; a null ``page_id`` counts as largest; a null ``url`` has no target header, control characters
in it are percent-encoded; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import cut

PIECE = 1 << 16
ARCHIVE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def with_targets(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, first)``: ``first`` is the page that a repeated payload refers to, else null.

    Only ids and digests are grouped; the payloads move once, by page id.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = own.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1("html").alias("sha")).distinct()
    lowest = keys.groupBy("sha").agg(F.min("page_id").alias("first"))
    repeats = keys.join(lowest, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first")
    same = own.page_id.eqNullSafe(repeats.p) & (F.sha1(own.html) == repeats.s)
    return own.join(repeats, same, "left").select("page_id", "url", "html", "first")


def encode_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, level: int = 6, date: str = DATE) -> bytes:
    """One record as a gzip member; ``first`` makes it a revisit without payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in ``folder``; the manifest ``(path, records)``."""

    folder = re.sub(r"^file:/+", "file:///", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, out, path, size, records = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, records = store.open_output_stream(path, compression=None), 0, 0
                member = encode_record(page_id, url, html.encode(), first, level)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    out.close()
                    done, out = [*done, (path, records)], None
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    root = fs.FileSystem.from_uri(folder)[1]
    manifest = cut(with_targets(pages, min_bytes).mapInArrow(write, "path string, records long"))
    return manifest.withColumn("path", F.concat(F.lit(folder.removesuffix(root)), "path"))


class Members:
    """Bytes of one gzip member after the other, inflated piece by piece."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.packed, self.plain, self.unpacker = stream, piece, b"", b"", None

    def begin(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.packed:
            self.packed = self.stream.read(self.piece)
        self.unpacker, self.plain = zlib.decompressobj(31), b""
        return bool(self.packed)

    def _more(self) -> bool:
        while not self.unpacker.eof:
            if not self.packed:
                self.packed = self.stream.read(self.piece)
                if not self.packed:
                    raise ValueError("the archive ends inside a member")
            made = self.unpacker.decompress(self.packed, self.piece)
            self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if made:
                self.plain += made
                return True
        return False

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                raise ValueError("a header line has no end")
        line, self.plain = self.plain[:end], self.plain[end + 2 :]
        return line

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.plain and not self._more():
                raise ValueError("a block is shorter than its Content-Length")
            got, self.plain = self.plain[:n], self.plain[n:]
            n -= len(got)
            yield got

    def end(self) -> None:
        while self._more():
            pass
        if self.plain != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")


def _headers(member: Members) -> dict[str, str]:
    out = {}
    while line := member.line():
        name, _, value = line.decode().partition(": ")
        out[name.lower()] = value
    return out


def read_records(stream, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of ``RECORD`` of one archive, in order. A wrong frame or digest raises ``ValueError``."""
    members = Members(stream)
    while members.begin():
        if members.line() != b"WARC/1.1":
            raise ValueError("a record does not start with its version")
        head = _headers(members)
        left = int(head["content-length"])
        block, payload, kept, http = hashlib.sha1(), hashlib.sha1(), [], b""
        in_body = False
        for piece in members.pieces(left):
            block.update(piece)
            if not in_body:
                http += piece
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece, in_body = http[:end], http[end + 4 :], True
            payload.update(piece)
            if with_payload:
                kept.append(piece)
        members.end()
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        named = head["warc-payload-digest"].removeprefix("sha1:")
        if base64.b32encode(block.digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {head['warc-record-id']} differs")
        revisit = head["warc-type"] == "revisit"
        if not revisit and base64.b32encode(payload.digest()).decode() != named:
            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
        ids = [int(v) if (v := head.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id")]
        yield ids[0], size, named, head["warc-type"], ids[1], head.get("warc-target-uri"), b"".join(kept) if with_payload and not revisit else None


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of ``RECORD`` of every archive of the manifest; one task reads one archive."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream, with_payload):
                        rows.append(row)
                        size += len(row[-1] or b"") + 200
                        if size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)
