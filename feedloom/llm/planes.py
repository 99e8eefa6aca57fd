"""Token ids as files of shuffled bit or byte planes.

A shard file::

    magic  b"FLPLANE1"
    chunks plane after plane, each compressed with zstandard on its own
    docs   blocks of the table of documents between the chunks, each zstandard
           of: id (int64), null flag (uint8) and length (int64) columns
    index  JSON: kind of planes, width, and for each chunk its offset, its
           number of ids and the length of each compressed plane; for each
           block of documents its offset, length and number of documents
    u64    length of the index, then the magic again

A chunk holds a fixed number of ids.  Its ids are transposed: plane *k* holds
byte (or bit) *k* of every id, so the planes of high bytes are almost constant
and shrink to nothing.  A reader needs the index and the chunks it wants.

Shards hold ranges of ascending document ids; a task writes its shard to a
name of its own, and only the names that tasks return count, so a task that
runs again after a lost executor does no harm.

Writers and readers hold one chunk of ids and one block of documents, whatever
the shard's size; the number of shards follows the bytes of the input, and a
range of rows that repeat an id is split by the beginnings of their texts.

Defined results: a null text counts as empty and has the end id alone; null ids
come first; rows that repeat an id follow each other, ordered by text.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_partitions, shared_root, table, tidy
from .tokens import encoder, tokenizer_path

MAGIC = b"FLPLANE1"
CHUNK = 1 << 16
BLOCK = 1 << 16


def shuffle(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of ids, lowest first."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width)
    if bits:
        raw = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(raw[:, k], bitorder="little").tobytes() for k in range(raw.shape[1])]
    return [raw[:, k].tobytes() for k in range(width)]


def unshuffle(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        raw = np.packbits(np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1), axis=1, bitorder="little")
    else:
        raw = np.stack(rows, axis=1)
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(n)


class PlaneWriter:
    """Writes one shard to a binary stream; memory holds one chunk of ids and one block of documents."""

    def __init__(self, out, width: int = 4, bits: bool = False, chunk: int = CHUNK, level: int = 3, block: int = BLOCK):
        self.out, self.width, self.bits, self.chunk, self.block = out, width, bits, chunk, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.held, self.chunks = 0, [], 0, []
        self.names, self.nulls, self.lengths, self.blocks, self.n_docs = array("q"), bytearray(), array("q"), [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        if len(self.names) >= self.block:
            self._flush_docs()
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            flat = np.concatenate(self.waiting)
            cut = len(flat) // self.chunk * self.chunk
            for k in range(0, cut, self.chunk):
                self._flush(flat[k : k + self.chunk])
            self.waiting, self.held = [flat[cut:].copy()], len(flat) - cut

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in shuffle(ids, self.width, self.bits)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self._put(b"".join(planes))

    def _flush_docs(self) -> None:
        if self.names:
            raw = self.zstd.compress(np.array(self.names, "<i8").tobytes() + bytes(self.nulls) + np.array(self.lengths, "<i8").tobytes())
            self.blocks.append([self.at, len(raw), len(self.names)])
            self.n_docs += len(self.names)
            self._put(raw)
            self.names, self.nulls, self.lengths = array("q"), bytearray(), array("q")

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        self._flush_docs()
        index = {"bits": self.bits, "width": self.width, "chunks": self.chunks, "docs": self.blocks}
        text = json.dumps(index, separators=(",", ":")).encode()
        self._put(text + struct.pack("<Q", len(text)) + MAGIC)


class PlaneReader:
    """Reads a shard from a seekable stream, a chunk at a time."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        n, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(end - 16 - n)
        self.index = json.loads(source.read(n))
        self.zstd = zstandard.ZstdDecompressor()

    def documents(self) -> Iterator[tuple[int | None, int]]:
        for at, size, n in self.index["docs"]:
            self.source.seek(at)
            raw = self.zstd.decompress(self.source.read(size))
            ids, nulls, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)
            for i, z, k in zip(ids.tolist(), nulls.tolist(), lengths.tolist(), strict=True):
                yield None if z else i, k

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.source.seek(at)
        planes = [self.zstd.decompress(self.source.read(s)) for s in sizes]
        return unshuffle(planes, n, self.index["width"], self.index["bits"])

    def __iter__(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Documents with their ids, in pieces as the chunks hold them."""
        k, rest = 0, np.empty(0, f"<u{self.index['width']}")
        for doc, n in self.documents():
            parts = []
            while n:
                if not len(rest):
                    rest, k = self.chunk(k), k + 1
                parts.append(rest[:n])
                n -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            yield doc, parts


def open_path(path: str, mode: str):
    """A stream on any file system that pyarrow knows; ``path`` may be a URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "wb":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


def _write(folder: str, path: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        end = np.array([end_id], code.dtype)
        part = TaskContext.get().partitionId()
        name, out, ids = f"{folder}/{part:06d}-{uuid.uuid4().hex}.planes", None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, raw in zip(batch.column(0).slice(at, 256).to_pylist(), code.encode(batch.column(1).slice(at, 256).to_pylist()), strict=True):
                    if out is None:
                        stream = open_path(name, "wb")
                        out = PlaneWriter(stream, width=4, bits=bits)
                    whole = np.concatenate([np.frombuffer(raw, code.dtype), end])
                    out.add(doc, whole)
                    ids += len(whole)
        if out is not None:
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([ids], pa.int64()), pa.array([out.n_docs], pa.int64())], names=["part", "path", "ids", "docs"])

    return run


def write_planes(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, bits: bool = False, tokenizer: str | None = None, shards: int | None = None) -> list[tuple[str, int, int]]:
    """Write shards in ascending id order: (path, ids before it, ids in it), one a shard."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = shards or input_partitions(rows)
    rows = rows.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(tidy(_write(folder, path, end_id, bits)), "part int, path string, ids long, docs long").collect()  # one row a shard
    out, before = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        out.append((r["path"], before, r["ids"]))
        before += r["ids"]
    with open_path(f"{folder}/MANIFEST.json", "wb") as f:
        f.write(json.dumps([{"path": p, "start": b, "ids": n} for p, b, n in out]).encode())
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open_path(path, "rb") as f:
                rows = []
                for doc, parts in PlaneReader(f):
                    crc, n = 0, 0
                    for p in parts:
                        crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                    rows.append((doc, start, n, crc))
                    start += n
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_planes(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    names = spark.createDataFrame([(p, b) for p, b, _ in shards], "path string, start long")
    return names.repartition(max(1, len(shards))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/planes-{uuid.uuid4().hex}"
    return read_planes(spark, write_planes(table(spark, sf_dir, "documents"), folder))
