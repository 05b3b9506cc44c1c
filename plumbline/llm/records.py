"""Token sequences as length-delimited binary records with masked checksums, and a separate offset index.

A data file is a header (magic, bytes per id) and frames: length of the payload (u64), its masked checksum (u32),
payload, masked checksum of the payload (u32), all little-endian. A payload is: has-id (u8), doc_id (i64), ids. The index beside it has for each
record: doc_id (i64), has-id (u8), offset of the frame (u64), number of ids (u64), so readers can go to records in any order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, small_batches, stage
from plumbline.llm.files import dealt, reading, writing

MAGIC = b"IDS1"
_LENGTH, _SUM, _HEAD, _ENTRY = "<Q", "<I", "<Bq", "<qBQQ"
_MASK = 0xA282EAD8
#: Runs of ASCII blanks with what follows: no token of a byte-level BPE crosses their starts, unless another blank stands before.
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_OTHER_BLANK = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def masked(data: bytes) -> int:
    """A checksum rotated and shifted, so that checksums of data that holds checksums stay useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack(_LENGTH, len(payload))
    return b"".join((head, struct.pack(_SUM, masked(head)), payload, struct.pack(_SUM, masked(payload))))


def read_frame(f: BinaryIO) -> bytes | None:
    """The next payload; None at the end of the file. Raises ValueError on a damaged frame."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from(_SUM, head, 8)[0] != masked(head[:8]):
        raise ValueError("damaged length")
    n = struct.unpack_from(_LENGTH, head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or struct.unpack_from(_SUM, body, n)[0] != masked(body[:n]):
        raise ValueError("damaged payload")
    return body[:n]


class Encoder:
    """Whole texts to ids with a byte-level BPE of the tokenizers library; the ids equal those of encoding the text at once.

    A text is cut where no token can cross, and pieces seen before are not encoded again; new pieces of a batch are encoded in
    one call, joined, and the ids cut by their lengths in bytes. Texts with rarer kinds of blanks, or with the literal of an added token, which
    the library takes as that token, are encoded as they are. Pieces are numbered as they come, and a number stands for the piece's ids in one array;
    past ``remember`` pieces the numbering begins anew.
    """

    def __init__(self, path: str, remember: int = 1_000_000) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self._added = re.compile("|".join([re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]) or r"(?!)")
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self._bytes = np.zeros(size, dtype=np.int64)
        self._bytes[list(vocab.values())] = [len(k) for k in vocab]
        self._remember = remember
        self._forget()

    def _forget(self) -> None:
        self._number: defaultdict[str, int] = defaultdict(count().__next__)
        self._ids = np.empty(0, dtype=self.dtype)
        self._first = self._size = np.empty(0, dtype=np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces. Those that begin with a blank and end with none are encoded some hundred at a time as one text, since no token crosses their starts."""
        ids: dict[str, bytes] = {}
        joined = [w for w in new if w[0] in " \t\n\r" and w[-1] not in " \t\n\r"]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        wholes = ["".join(g) for g in groups]
        if any(self._added.search(w) for w in wholes):  # only together do they spell an added token
            groups, wholes = [], []
        for group, data in zip(groups, self._whole(wholes), strict=True):
            ends = np.cumsum(self._bytes[np.frombuffer(data, dtype=self.dtype)])
            stops = (np.searchsorted(ends, np.cumsum([len(w.encode("utf-8")) for w in group])) + 1) * self.dtype.itemsize
            start = 0
            for w, stop in zip(group, stops.tolist(), strict=True):
                ids[w] = data[start:stop]
                start = stop
        rest = [w for w in new if w not in ids]
        ids |= zip(rest, self._whole(rest), strict=True)
        return [ids[w] for w in new]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, copied piece by piece from those of the pieces."""
        pieces = [None if _OTHER_BLANK.search(t) or self._added.search(t) else _PIECE.findall(t) for t in texts]
        places = [w for p in pieces if p is not None for w in p]
        if len(self._number) > self._remember or len(self._number) != self._size.size:  # full, or a batch failed half-way
            self._forget()
        before = len(self._number)
        at = np.fromiter(map(self._number.__getitem__, places), dtype=np.int64, count=len(places))
        if len(self._number) > before:
            learned = self._learn(list(islice(self._number, before, None)))
            sizes = np.array([len(x) for x in learned], dtype=np.int64) // self.dtype.itemsize
            self._first = np.concatenate((self._first, self._ids.size + np.cumsum(sizes) - sizes))
            self._size = np.concatenate((self._size, sizes))
            self._ids = np.concatenate((self._ids, np.frombuffer(b"".join(learned), dtype=self.dtype)))
        own = self._size[at]
        ends = np.cumsum(own)
        ids = self._ids[np.repeat(self._first[at] - (ends - own), own) + np.arange(ends[-1] if ends.size else 0)].tobytes()
        counts = np.cumsum([0 if p is None else len(p) for p in pieces], dtype=np.int64)
        stops = (np.concatenate(([0], ends))[counts] * self.dtype.itemsize).tolist()
        odd = iter(self._whole([t for t, p in zip(texts, pieces, strict=True) if p is None]))
        return [next(odd) if p is None else ids[start:stop] for p, start, stop in zip(pieces, [0, *stops], stops, strict=False)]


def chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(start, stop) of neighbouring texts of about ``chars`` characters together, one at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > chars and i > start:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending doc_id order (null first, rows of one id
    by text). Returns the manifest: one row (part, path, n_records, n_ids) per data file, parts in order; the index is at path + ".index".

    Null text is empty: its ids are the end id alone. An empty table makes no file. Texts are moved once, to their
    place in the order, and streamed to the file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = next(batches, None)
        if first is None:
            return
        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=e.dtype).tobytes()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        records = ids = 0
        with writing(path) as out, writing(path + ".index") as index:
            out.write(MAGIC + bytes([e.dtype.itemsize]))
            at = len(MAGIC) + 1
            keys: list[int | None] = []
            texts: list[str] = []
            while first is not None:
                keys += first.column(0).to_pylist()
                texts += [t or "" for t in first.column(1).to_pylist()]
                first = next(batches, None)
                for start, stop in chunks(texts):
                    if stop == len(texts) and first is not None:  # waits for more
                        keys, texts = keys[start:], texts[start:]
                        break
                    for key, data in zip(keys[start:stop], e.encode(texts[start:stop]), strict=True):
                        data += end
                        n = len(data) // e.dtype.itemsize
                        index.write(struct.pack(_ENTRY, key or 0, key is not None, at, n))
                        at += out.write(whole := frame(struct.pack(_HEAD, key is not None, key or 0) + data)) or len(whole)
                        records, ids = records + 1, ids + n
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_records": [records], "n_ids": [ids]})

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_t"))
    ordered = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_t").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_t").select("doc_id", "text")
    return stage(ordered.mapInArrow(write, "part long, path string, n_records long, n_ids long"), "manifest")


def read_index(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, offset of the frame, number of ids) of each record of a data file."""
    with reading(path + ".index") as f:
        while block := f.read(struct.calcsize(_ENTRY) * 4096):
            for key, has, at, n in struct.iter_unpack(_ENTRY, block):
                yield (key if has else None), at, n


def read_record(f: BinaryIO, offset: int, width: int) -> tuple[int | None, np.ndarray]:
    """The record whose frame is at ``offset`` of an open data file."""
    f.seek(offset)
    payload = read_frame(f)
    if payload is None:
        raise ValueError("no record there")
    has, key = struct.unpack_from(_HEAD, payload)
    return (key if has else None), np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(_HEAD))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files: start counts the ids of all records before it,
    ids_crc32 is of the ids as little-endian unsigned 32-bit integers. Both checksums of every frame and the index are verified."""
    small_batches(manifest.sparkSession)
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with reading(path, random=True) as f:
                    head = f.read(len(MAGIC) + 1)
                    if head[:-1] != MAGIC:
                        raise ValueError(f"{path} is not a token file")
                    for key, at, n in read_index(path):
                        own, ids = read_record(f, at, head[-1])
                        if own != key or ids.size != n:
                            raise ValueError(f"{path}: the index does not fit")
                        rows.append((key, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += n
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return dealt(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(4)], names=list(names))
