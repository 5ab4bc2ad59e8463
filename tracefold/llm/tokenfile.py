"""Token ids in files of fixed-width bit packing.

A file holds the ids of consecutive documents, each id in the least number of bits that the
vocabulary needs. 64 ids are a group of as many 64-bit words as an id has bits, so that NumPy packs
and unpacks whole columns of groups; a block is `BLOCK` ids in whole groups. Behind the blocks stand
the blocks' offsets, the documents' numbers and the documents' first ids, then a trailer: any range
of ids is read by its blocks alone, any document by its place in the table.

    magic, blocks..., offsets of blocks and of their end (u64), document ids (i64), whether they
    are null (u8), first ids of documents and the end (u64), trailer

Writing sorts documents over the cluster by id; a task encodes its range and writes one file, or
more of about `file_ids` ids. What it returns, a row a file, is written as a table: a file counts
when that table names it, so tasks that run twice leave files that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows, shared_dir
from .packing import TextEncoder, default_vocabulary

BLOCK = 1 << 16
END_ID = 2
_MAGIC = b"TOKBITS1"
_TRAILER = struct.Struct("<8sQQQQII")


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below `2 ** bits` as whole groups; a last group is filled with zeros."""
    groups = -(-len(ids) // 64)
    wide = np.zeros((groups, 64), np.uint64)
    wide.reshape(-1)[: len(ids)] = ids
    wide = np.ascontiguousarray(wide.T)
    out = np.zeros((bits, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[word] |= wide[k] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= wide[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    """The ids of whole groups."""
    groups = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    out = np.empty((64, groups.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = groups[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | groups[word + 1] << np.uint64(64 - shift)
        out[k] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)


class TokenFileWriter:
    """Writes documents' ids to a stream; holds one block at a time, and 17 bytes a document."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        if not 1 <= bits <= 32 or block % 64:
            raise ValueError("ids take 1 to 32 bits, blocks whole groups of 64")
        self.stream, self.bits, self.block = stream, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.firsts, self.offsets = [0], [len(_MAGIC)]
        stream.write(_MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self.firsts.append(self.n_ids)
        if self.n_held >= self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for k in range(0, n, self.block):
            data = pack_bits(ids[k : min(k + self.block, n)], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        table = self.offsets[-1]
        ids = np.array([0 if x is None else x for x in self.doc_ids], "<i8")
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        for x in (np.array(self.offsets, "<u8"), ids, null, np.array(self.firsts, "<u8")):
            self.stream.write(x.tobytes())
        self.stream.write(_TRAILER.pack(_MAGIC, table, len(self.offsets) - 1, len(ids), self.n_ids, self.bits, self.block))
        self.stream.close()


class TokenFile:
    """Reads ranges of ids of a random-access file."""

    def __init__(self, f):
        self.file = f
        f.seek(f.size() - _TRAILER.size)
        magic, table, blocks, docs, self.n_ids, self.bits, self.block = _TRAILER.unpack(f.read(_TRAILER.size))
        if magic != _MAGIC:
            raise ValueError("no token file")
        f.seek(table)
        read = lambda n, kind: np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        self.offsets, self.doc_ids = read(blocks + 1, "<u8").astype(np.int64), read(docs, "<i8")
        self.null, self.first = read(docs, np.uint8) == 1, read(docs + 1, "<u8").astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids `low` to `high - 1`, from their blocks alone."""
        if low >= high:
            return np.zeros(0, np.uint32)
        a, b = low // self.block, (high - 1) // self.block + 1
        self.file.seek(int(self.offsets[a]))
        ids = unpack_bits(self.file.read(int(self.offsets[b] - self.offsets[a])), self.bits)
        return ids[low - a * self.block : high - a * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each document; about `most` ids at a time are unpacked."""
        low, n = 0, len(self.doc_ids)
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.first, self.first[low] + most, "right")) - 1)
            ids, base = self.ids(int(self.first[low]), int(self.first[high])), int(self.first[low])
            for i in range(low, high):
                yield None if self.null[i] else int(self.doc_ids[i]), int(self.first[i]), ids[self.first[i] - base : self.first[i + 1] - base]
            low = high


# --- over a table --------------------------------------------------------------------------


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


_FILE = "part int, number int, file string, n_docs long, n_ids long"
_FILE_ARROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, file_ids: int = 1 << 24) -> None:
    """Writes the ids of `docs` (doc_id, text; other columns are ignored) to a new folder `path`
    in ascending doc_id, `end_id` after each document.

    Null text is empty: its end id alone. Rows with a null doc_id come first; rows of one id follow
    each other by a hash of their text. An empty table gives a folder without token files.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(vocabulary)
        bits = max(encode.size - 1, end_id).bit_length()
        end = np.array([end_id], np.uint32)
        context = TaskContext.get()
        system, folder = _system(path)
        system.create_dir(folder, recursive=True)
        made: list[tuple] = []
        out, name = None, ""

        def done() -> None:
            out.close()
            made.append((context.partitionId(), len(made), name, len(out.doc_ids), out.n_ids))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    name = f"ids-{context.partitionId():06d}-{len(made):04d}-{uuid.uuid4().hex[:12]}.bits"
                    out = TokenFileWriter(system.open_output_stream(f"{folder}/{name}"), bits)
                out.add(doc_id, np.concatenate([encode.ids(text.as_py()), end]))
                if out.n_ids >= file_ids:
                    done()
                    out = None
        if out is not None:
            done()
        if made:
            yield rows(_FILE_ARROW, dict(zip(_FILE_ARROW.names, zip(*made, strict=True), strict=True)))

    text = F.coalesce("text", F.lit(""))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # The last key parts rows that repeat an id and a text, however many they are.
    placed = placed.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    placed.select("doc_id", "text").mapInArrow(run, _FILE).write.parquet(f"{path}/files")


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of the folder: its place, name, numbers of documents and ids, and `start`,
    the ids of all files before it. One window over as many rows as there are files."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(_FILE).parquet(f"{path}/files")
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned
    32-bit) of each document in the folder's files."""
    return _documents(spark, path, "ids binary", [("ids", pa.binary())], lambda ids: ids.astype("<u4").tobytes())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As `read_tokens`, with an unsigned crc32 of the ids in their place."""
    return _documents(spark, path, "ids_crc32 long", [("ids_crc32", pa.int64())], lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _documents(spark: SparkSession, path: str, kind: str, field: list, value) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                with system.open_input_file(f"{folder}/{name}") as f:
                    for doc_id, first, ids in TokenFile(f).documents():
                        out.append((doc_id, base + first, len(ids), value(ids)))
                        if len(out) == 4096:
                            yield rows(schema, dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                            out = []
                if out:
                    yield rows(schema, dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    # A task a file: the table of files is small, what it names isn't.
    files = token_files(spark, path).select("file", "start")
    files = files.repartitionByRange(max(1, spark.read.schema(_FILE).parquet(f"{path}/files").count()), "start")
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(spark, path)
