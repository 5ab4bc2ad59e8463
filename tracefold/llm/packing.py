"""Cost-balanced packing of documents into token sequences.

A document's ids are its text's byte-level BPE ids followed by one end id. Whole runs of
`capacity` ids are sequences of their own; what remains of each document is assigned in
descending length to the sequence of lowest cost that has room for it, where the cost of a
sequence is `linear * tokens + quadratic * sum(piece length ** 2)` (attention stays inside a
piece). What fits nowhere is cut over the sequences with most room. The sequences of a group
hold exactly its ids: beside full ones there is at most one for each power of two, so that
nothing is padded.

A group is a run of rows of one input partition with about `group_tokens` ids, so that a task
holds one group at a time, nothing is shuffled, and a lost task is redone from its input split.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
END_ID = 1
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
#: The vocabulary's pattern for splitting text. A fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary of a byte-level BPE file in the library that merges fastest."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    vocabulary = stored["model"]["vocab"]
    added = {x["content"]: x["id"] for x in stored.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and token not in added}
    return tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)


class TextEncoder:
    """ids of texts. A token that the vocabulary's file adds, such as its end of text, is one id."""

    def __init__(self, path: str):
        self._encoder = _encoder(path)
        self.size = self._encoder.n_vocab

    def ids(self, text: str) -> np.ndarray:
        return self._encoder.encode_to_numpy(text, allowed_special="all")

    def __call__(self, text: str) -> bytes:
        """As little-endian unsigned 32-bit integers."""
        return self.ids(text).astype("<u4").tobytes()


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Pieces (item, start, length) of each sequence; items are shorter than `capacity`."""
    total = int(lengths.sum())
    room = [capacity] * (total // capacity)
    room += [1 << k for k in reversed(range(capacity.bit_length())) if (total % capacity) >> k & 1]
    room = np.array(room, np.int64)
    cost = np.zeros(len(room))
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in room]
    late = []

    def put(where: int, item: int, start: int, n: int) -> None:
        pieces[where].append((item, start, n))
        room[where] -= n
        cost[where] += linear * n + quadratic * n * n

    for item in np.argsort(-lengths, kind="stable"):
        n = int(lengths[item])
        if not n:
            continue
        where = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[where] >= n:
            put(where, int(item), 0, n)
        else:
            late.append(int(item))
    for item in late:
        start, n = 0, int(lengths[item])
        while start < n:
            where = int(np.argmax(room))
            part = min(n - start, int(room[where]))
            put(where, item, start, part)
            start += part
    return pieces


def _pack(docs: list[tuple[int | None, bytes]], group: int, capacity: int, linear: float, quadratic: float) -> pa.RecordBatch:
    out: list[list] = [[] for _ in SCHEMA.fields]
    tokens = np.array([len(ids) // 4 for _, ids in docs], np.int64)
    sequence = group << 20

    def emit(i: int, start: int, n: int, offset: int) -> None:
        doc_id, ids = docs[i]
        for column, value in zip(out, (doc_id, start, n, int(tokens[i]), sequence, offset, ids[4 * start : 4 * (start + n)]), strict=True):
            column.append(value)

    for i, n in enumerate(tokens):
        for start in range(0, int(n) - capacity + 1, capacity):
            emit(i, start, capacity, 0)
            sequence += 1
    whole = tokens // capacity * capacity
    for sequence_pieces in assign(tokens - whole, capacity, linear, quadratic):
        offset = 0
        for i, start, n in sequence_pieces:
            emit(i, int(whole[i]) + start, n, offset)
            offset += n
        sequence += 1
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=SCHEMA.names)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text; other columns are ignored).

    `capacity` is a power of two. Null or empty text is the end id alone. Rows with a null or
    repeated doc_id are packed each on its own and carry their id. An empty table gives an
    empty table.
    Returns `SCHEMA`; `ids` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(path)
        part = TaskContext.get().partitionId()
        held, size, groups = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= group_tokens:
                    yield _pack(held, part << 20 | groups, capacity, linear, quadratic)
                    held, size, groups = [], 0, groups + 1
        if held:
            yield _pack(held, part << 20 | groups, capacity, linear, quadratic)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with an unsigned crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return with_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
