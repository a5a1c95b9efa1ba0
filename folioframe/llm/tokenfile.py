"""Binary files of token ids: fixed-size blocks in bit or byte planes, compressed, with a chunk index.

A file holds the ids of consecutive documents. The ids are cut into blocks of a
fixed number; a block is transposed, so that the first bytes (or bits) of all
its ids lie together, then the second ones, and every such plane is compressed
by itself: the high planes of small ids are nearly empty. Behind the blocks
stand the index of the chunks (place, number of ids, compressed size of every
plane, checksum) and the table of documents; the trailer tells where they begin.
All numbers are little-endian::

    header   magic, version, planes (1: bytes, 2: bits), ids per block
    chunks   the compressed planes of each block
    index    per chunk: offset u64, ids u32, crc32 u32, size of each plane u32
    table    compressed: per document its id i64, whether it is null u8, its number of ids u64
    trailer  offset of the index u64, chunks u64, documents u64, ids u64, magic

Documents are dealt to files by ranges of their ids, so the files in their order
hold all documents in ascending order. A task encodes its range as it writes and
holds a few blocks at a time. Files get their names when they are whole, and a
task that runs again writes the same file.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.base import bounded_batches, byte_slices, in_files, key_columns, shared_path, tidy, written
from folioframe.llm.packing import word_token_ids

MAGIC = b"idplanes"
VERSION = 1
BYTES, BITS = 1, 2
_HEADER = np.dtype([("magic", "S8"), ("version", "<u4"), ("planes", "<u4"), ("block", "<u8")])
_TRAILER = np.dtype([("index", "<u8"), ("chunks", "<u8"), ("documents", "<u8"), ("ids", "<u8"), ("magic", "S8")])
_DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])


def _chunk_type(planes: int) -> np.dtype:
    return np.dtype([("offset", "<u8"), ("ids", "<u4"), ("crc", "<u4"), ("sizes", "<u4", (4 if planes == BYTES else 32,))])


@dataclass(frozen=True)
class Layout:
    """Ids per block, kind of planes, compression level, and the ids or documents after which a file ends."""

    block: int = 1 << 16
    planes: int = BYTES
    level: int = 1
    file_ids: int = 1 << 26
    file_documents: int = 1 << 20


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTES:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int, planes: int) -> np.ndarray:
    if planes == BYTES:
        return np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), plain) if plain.startswith("/") else pa.fs.FileSystem.from_uri(plain)


@dataclass
class Writer:
    """Writes one file; it has its name only after :meth:`close`."""

    path: str
    layout: Layout
    documents: int = 0
    ids: int = 0
    _rest: list[np.ndarray] = field(default_factory=list)
    _waiting: int = 0

    def __post_init__(self):
        self.fs, self.place = file_system(self.path)
        self.fs.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.place}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.press = zstandard.ZstdCompressor(level=self.layout.level)
        self.index: list[tuple] = []
        self.table: list[np.ndarray] = []
        self._put(np.array([(MAGIC, VERSION, self.layout.planes, self.layout.block)], dtype=_HEADER).tobytes())

    def _put(self, data: bytes) -> None:
        self.out.write(data)

    def append(self, names: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their ids behind one another."""
        rows = np.zeros(len(names), dtype=_DOCUMENT)
        rows["id"], rows["null"], rows["n"] = [x or 0 for x in names], [x is None for x in names], counts
        self.table.append(rows)
        self.documents, self.ids = self.documents + len(names), self.ids + len(ids)
        self._rest.append(ids)
        self._waiting += len(ids)
        if self._waiting >= self.layout.block:
            ready, block = np.concatenate(self._rest), self.layout.block
            whole = len(ready) // block * block
            for at in range(0, whole, block):
                self._chunk(ready[at:at + block])
            self._rest, self._waiting = [ready[whole:].copy()], len(ready) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        ids, offset = ids.astype("<u4"), self.out.tell()
        parts = [self.press.compress(p) for p in to_planes(ids, self.layout.planes)]
        self._put(b"".join(parts))
        self.index.append((offset, len(ids), zlib.crc32(ids), [len(p) for p in parts]))

    def close(self) -> None:
        if self._waiting:
            self._chunk(np.concatenate(self._rest))
        at = self.out.tell()
        self._put(np.array(self.index, dtype=_chunk_type(self.layout.planes)).tobytes())
        self._put(self.press.compress(np.concatenate([np.zeros(0, dtype=_DOCUMENT), *self.table]).tobytes()))
        self._put(np.array([(at, len(self.index), self.documents, self.ids, MAGIC)], dtype=_TRAILER).tobytes())
        self.out.close()
        self.fs.move(self.temporary, self.place)


class Reader:
    """Reads a file by its index."""

    def __init__(self, path: str):
        self.fs, self.place = file_system(path)
        self.data = self.fs.open_input_file(self.place)
        size = self.data.size()
        header = np.frombuffer(self._at(0, _HEADER.itemsize), dtype=_HEADER)[0]
        trailer = np.frombuffer(self._at(size - _TRAILER.itemsize, _TRAILER.itemsize), dtype=_TRAILER)[0]
        if header["magic"] != MAGIC or trailer["magic"] != MAGIC or header["version"] != VERSION:
            raise ValueError(f"{path} is no file of token ids, or is not whole")
        self.planes, self.block, self.ids = int(header["planes"]), int(header["block"]), int(trailer["ids"])
        kind = _chunk_type(self.planes)
        at, length = int(trailer["index"]), int(trailer["chunks"]) * kind.itemsize
        self.index = np.frombuffer(self._at(at, length), dtype=kind)
        table = zstandard.ZstdDecompressor().decompress(
            self._at(at + length, size - _TRAILER.itemsize - at - length), max_output_size=max(1, int(trailer["documents"]) * _DOCUMENT.itemsize))
        self.documents = np.frombuffer(table, dtype=_DOCUMENT)

    def _at(self, offset: int, size: int) -> bytes:
        self.data.seek(offset)
        return self.data.read(size)

    def chunk(self, number: int) -> np.ndarray:
        """The ids of a chunk, which are checked."""
        row, press = self.index[number], zstandard.ZstdDecompressor()
        sizes = row["sizes"].astype(np.int64)
        data, ends, n = self._at(int(row["offset"]), int(sizes.sum())), np.cumsum(sizes), int(row["ids"])
        width = n if self.planes == BYTES else -(-n // 8)
        ids = from_planes([press.decompress(data[e - s:e], max_output_size=width) for e, s in zip(ends, sizes)], n, self.planes)
        if zlib.crc32(np.ascontiguousarray(ids)) != row["crc"]:
            raise ValueError(f"chunk {number} of {self.place} is damaged")
        return ids

    def tokens(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on; reads the chunks that hold them only."""
        first, last = start // self.block, -(-min(start + count, self.ids) // self.block)
        parts = [self.chunk(i) for i in range(first, last)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *parts])[start - first * self.block:][:max(0, count)]

    def each(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """Every document: its id, the ids before it in the file, their number, and the ids in parts, to be taken before the next one."""
        at, number, chunk = 0, -1, np.zeros(0, dtype="<u4")

        def parts(begin: int, end: int):
            nonlocal number, chunk
            while begin < end:
                if begin // self.block != number:
                    number = begin // self.block
                    chunk = self.chunk(number)
                upto = min(end, (number + 1) * self.block)
                yield chunk[begin - number * self.block:upto - number * self.block]
                begin = upto

        for name, null, n in self.documents.tolist():
            yield (None if null else name), at, n, parts(at, at + n)
            at += n

    def close(self) -> None:
        self.data.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, layout: Layout = Layout(), end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts, each followed by ``end_id``, and writes them in ascending order of their ids; returns the list of files.

    ``file, path, documents, ids, before``: ``before`` is the number of ids in
    all files before. Without ``folder`` a new one in the shared folder is used;
    all executors have to reach it.

    A null or empty text is ``end_id`` alone; texts are encoded whole. Null ids
    come first; rows of equal ids follow their place in the input. An empty
    table has no files.
    """
    bounded_batches(docs.sparkSession)
    folder = folder or shared_path(docs.sparkSession, "tokens")
    rows = in_files(docs).select(F.col(id_col).cast("long").alias("doc_id"), *key_columns(), F.col(text_col).cast("string").alias("text"))
    order = rows.columns[:3]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, None
        done: list[tuple] = []

        def finish() -> None:
            nonlocal out, seq
            out.close()
            done.append(((part << 24) + seq, out.path, out.documents, out.ids))
            out, seq = None, seq + 1

        for batch in batches:
            for begin, end in byte_slices(batch.column(1), 3_000_000):
                ids, counts = word_token_ids(batch.column(1).slice(begin, end - begin), tokenizer_path)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                out = out or Writer(f"{folder}/tokens-{part:08d}-{seq:06d}.bin", layout)
                out.append(batch.column(0).slice(begin, end - begin).to_pylist(), ids, counts + 1)
                if out.ids >= layout.file_ids or out.documents >= layout.file_documents:
                    finish()
        if out:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "path", "documents", "ids"), d)) for d in done], schema=pa.schema(
            [("file", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    files = written(dealt.mapInArrow(tidy(run), "file long, path string, documents long, ids long"), "files")
    # sums over files, by parts: no list of all files is sorted in one task
    inside, parts = Window.partitionBy("part").orderBy("file"), Window.orderBy("part")
    files = files.withColumn("part", F.expr("shiftright(file, 36)"))
    sums = files.groupBy("part").agg(F.sum("ids").alias("sum")).select("part", (F.sum("sum").over(parts) - F.col("sum")).alias("ahead"))
    return files.join(F.broadcast(sums), "part").withColumn("before", F.col("ahead") + F.sum("ids").over(inside) - F.col("ids")).select(
        "file", "path", "documents", "ids", "before")


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of ``files``, and on request its ``ids``.

    ``start`` is the number of ids of all documents before it; the checksum is
    that of the ids as little-endian unsigned 32-bit numbers.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, out, held = Reader(path), [], 0
                for name, at, n, parts in reader.each():
                    crc, ids = 0, []
                    for part in parts:
                        crc = zlib.crc32(part, crc)
                        if with_ids:
                            ids += part.tolist()
                    out.append((name, before + at, n, crc, ids)[:len(fields)])
                    held += len(ids) + 4
                    if held > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                reader.close()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    number = max(1, files.count())
    spark_schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.select("path", "before").repartition(number).mapInArrow(tidy(run), spark_schema)
