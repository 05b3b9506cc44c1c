"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with a sidecar offset index."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, small_batches, stage
from plumbline.llm.files import dealt, reading, remove, writing

#: page_id, has-id, offset of the member, its length.
_ENTRY = "<qBQQ"
_DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, body, bytes, digest, refers_to) per page: of equal payloads of at least ``min_bytes`` the largest page_id
    is written whole and the others refer to it; refers_to is null for what is written whole.

    Null html is an empty payload. Rows with the largest page_id of a payload are all written whole, as is every copy of a payload none of
    whose pages has an id. Only digests meet in the aggregation, combined before the shuffle; payloads move only if the digests that repeat are too many for a broadcast.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", body.alias("body"), F.octet_length(body).cast("bigint").alias("bytes"), F.sha1(body).alias("digest"))
    top = p.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    top = stage(top.select(F.col("digest").alias("same"), "top"), "repeats")
    key = F.when(F.col("bytes") >= min_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("digest")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return p.join(top, key == F.col("same"), "left").select("page_id", "url", "body", "bytes", "digest", refers.alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has the HTTP head alone."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}",
             "WARC-Target-URI: " + (_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + (body if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, block = raw.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    n = int(headers["content-length"])
    if len(block) != n + 4 or block[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers, block[:n]


class _Inflated:
    """Forward reads of a gzip stream of one or many members; holds one record and a little more."""

    def __init__(self, f: BinaryIO, chunk: int = 1 << 16) -> None:
        self.f, self.chunk, self.z, self.held = f, chunk, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        left = b""
        if self.z.eof:
            left, self.z = self.z.unused_data, zlib.decompressobj(31)
        data = left or self.f.read(self.chunk)
        if not data:
            return False
        self.held += self.z.decompress(data)
        return True

    def records(self) -> Iterator[bytes]:
        while True:
            at, seen = -1, 0
            while (at := self.held.find(b"\r\n\r\n", seen)) < 0:
                seen = max(0, len(self.held) - 3)
                if not self._more():
                    if self.held:
                        raise ValueError("the stream ends inside a record")
                    return
            m = re.search(rb"\r\ncontent-length: *(\d+)", self.held[:at], re.IGNORECASE)
            if not m:
                raise ValueError("a record without length")
            end = at + 4 + int(m[1]) + 4
            while len(self.held) < end:
                if not self._more():
                    raise ValueError("the stream ends inside a record")
            yield bytes(self.held[:end])
            del self.held[:end]


def write_streams(planned: DataFrame, folder: str, roll_bytes: int = 1 << 27, level: int = 4) -> DataFrame:
    """Write every planned page as a record into gzip streams of about ``roll_bytes`` before compression: (path, n_records) per file."""
    small_batches(planned.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        row = next(rows, None)
        while row is not None:
            path, z, size, n = f"{folder}/stream-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
            with writing(path) as out:
                while row is not None and size < roll_bytes:
                    data = record(*row)
                    out.write(z.compress(data))
                    size, n, row = size + len(data), n + 1, next(rows, None)
                out.write(z.flush())
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return stage(planned.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(write, "path string, n_records long"), "streams")


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Inflate each gzip stream of ``files`` (path) once, from start to end, and rewrite it with every record as its own gzip
    member; the offset index is written beside it, at path + ".index". Returns (path, n_records) of the new files.

    A task takes whole files but holds one record at a time. Streams may have one member or many.
    """
    ship = dealt(files.select("path"))
    small_batches(files.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source in (p for b in batches for p in b.column(0).to_pylist()):
            path, at, n = f"{folder}/records-{uuid.uuid4().hex}.warc.gz", 0, 0
            with reading(source) as f, writing(path) as out, writing(path + ".index") as index:
                for raw in _Inflated(f).records():
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    m = re.search(rb"\r\nX-Page-ID: (-?\d+)", raw[: raw.index(b"\r\n\r\n")])
                    index.write(struct.pack(_ENTRY, int(m[1]) if m else 0, m is not None, at, len(member)))
                    at, n = at + len(member), n + 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return stage(ship.mapInArrow(rewrite, "path string, n_records long"), "archives")


def read_index(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(page_id, offset, length of the member) of each record of a normalised archive."""
    with reading(path + ".index") as f:
        while block := f.read(struct.calcsize(_ENTRY) * 4096):
            for page, has, at, n in struct.iter_unpack(_ENTRY, block):
                yield (page if has else None), at, n


def read_record(f: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the member at ``offset``, without reading what stands before it."""
    f.seek(offset)
    return parse(zlib.decompress(f.read(length), 31))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each found through the index.
    Payloads of responses are hashed again and compared with their headers."""
    small_batches(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows: list[tuple] = []
            with reading(path, random=True) as f:
                for page, at, length in read_index(path):
                    h, block = read_record(f, at, length)
                    digest, size, kind = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), h["warc-type"]
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{path}: the payload at {at} is damaged")
                    own, to = h.get("x-page-id"), h.get("x-refers-to-page")
                    if page != (None if own is None else int(own)):
                        raise ValueError(f"{path}: the index does not fit")
                    rows.append((page, size, digest, kind, None if to is None else int(to)))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)

    return dealt(archives.select("path")).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000) -> DataFrame:
    """Write all ``pages`` (page_id, url, html; other columns ignored) and normalise: (path, n_records) of the archives.

    Null url is ``urn:unknown``; blanks and control characters in urls are percent-coded. Repeated rows are records of their own. An empty table
    makes no file. The streams are removed once all archives are written.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    streams = write_streams(plan_revisits(pages, min_bytes), folder)
    done = normalise(streams, folder)
    for row in streams.select("path").toLocalIterator():  # names of files
        remove(row.path)
    return done
