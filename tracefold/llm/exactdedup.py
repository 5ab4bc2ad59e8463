"""Exact duplicates by a cuckoo-filter index over live digests.

Each input task keeps an index of the digests it has seen and sends one row a digest, so that
no group of copies travels whole; a second index over each range of digests merges those rows.
The rows' keepers come back to the documents by a join on the digest, which Spark splits where
one digest has very many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The characters that equality ignores.
WHITE_SPACE = " \t\n\x0b\x0c\r"
_SLOTS = 4
_MASK = (1 << 64) - 1


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, beside the keys of each bucket.

    A lookup that the filter denies ends there. One that it admits is verified against the keys
    stored in the two buckets, so that equal fingerprints never join different digests. When an
    insertion finds no room after `kicks` moves, the table doubles and is filled again from the
    stored keys. `delete` takes a live digest out. Keys are bytes whose first 10 are uniform.
    """

    def __init__(self, buckets: int = 64, kicks: int = 64):
        self.size, self._buckets, self._kicks = 0, 1 << max(1, buckets - 1).bit_length(), kicks
        self._clear()

    def _clear(self) -> None:
        self._prints: list[list[int]] = [[] for _ in range(self._buckets)]
        self._keys: list[list[bytes]] = [[] for _ in range(self._buckets)]
        self._values: list[list] = [[] for _ in range(self._buckets)]

    @property
    def buckets(self) -> int:
        return self._buckets

    def _where(self, key: bytes) -> tuple[int, int, int]:
        x = int.from_bytes(key[:8], "little")
        mark = int.from_bytes(key[8:10], "little") | 1 << 16
        one = x & (self._buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E9955BD1E995 & _MASK) >> 24) & (self._buckets - 1)

    def _find(self, key: bytes) -> tuple[int, int] | None:
        mark, *both = self._where(key)
        for bucket in both:
            if mark in self._prints[bucket] and key in self._keys[bucket]:
                return bucket, self._keys[bucket].index(key)
        return None

    def __len__(self) -> int:
        return self.size

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) is not None

    def get(self, key: bytes):
        at = self._find(key)
        return None if at is None else self._values[at[0]][at[1]]

    def insert(self, key: bytes, value) -> None:
        """`key` isn't in the index."""
        self.size += 1
        while (homeless := self._place(key, value)) is not None:
            stored = [homeless, *self.items()]
            self._buckets *= 2
            self._clear()
            key, value = stored[0]
            for k, v in stored[1:]:
                if self._place(k, v) is not None:
                    raise AssertionError("a table of half the load has room")

    def _place(self, key: bytes, value):
        mark, one, two = self._where(key)
        bucket = one if len(self._prints[one]) <= len(self._prints[two]) else two
        for turn in range(self._kicks):
            if len(self._prints[bucket]) < _SLOTS:
                self._prints[bucket].append(mark)
                self._keys[bucket].append(key)
                self._values[bucket].append(value)
                return None
            slot = turn % _SLOTS
            for column, new in ((self._prints, mark), (self._keys, key), (self._values, value)):
                column[bucket].append(new)
            mark, key, value = self._prints[bucket].pop(slot), self._keys[bucket].pop(slot), self._values[bucket].pop(slot)
            bucket = self._other(bucket, mark)
        return key, value

    def delete(self, key: bytes) -> bool:
        at = self._find(key)
        if at is None:
            return False
        for column in (self._prints, self._keys, self._values):
            column[at[0]].pop(at[1])
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for keys, values in zip(self._keys, self._values, strict=True):
            yield from zip(keys, values, strict=True)


_GROUP = "digest binary, group_size long, n_chars long, keep_id long"


def _merge(max_live: int, sorted_by_digest: bool):
    """Merges rows of one digest that a task meets. The index stays below about `max_live`
    digests: what it holds goes on, and the digests are deleted. Where the rows come in the order
    of their digest's first two bytes, only digests of earlier prefixes go, so none can return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()

        def flush(before: bytes | None = None):
            done = [(k, v) for k, v in index.items() if before is None or k[:2] < before]
            for k, _ in done:
                index.delete(k)
            if done:
                columns = [[k for k, _ in done], [v[0] for _, v in done], [v[1] for _, v in done], [v[2] for _, v in done]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["digest", "group_size", "n_chars", "keep_id"])

        prefix = b""
        for batch in batches:
            for digest, size, n, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(index) >= max_live and (not sorted_by_digest or digest[:2] != prefix):
                    yield from flush(digest[:2] if sorted_by_digest else None)
                prefix = digest[:2]
                held = index.get(digest)
                if held is None:
                    index.insert(digest, [size, n, doc])
                else:
                    held[0] += size
                    if (-n, doc is None, doc) < (-held[1], held[2] is None, held[2]) if doc is not None and held[2] is not None else (-n, doc is None) < (-held[1], held[2] is None):
                        held[1:] = [n, doc]
        yield from flush()

    return run


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )


def groups(digested: DataFrame, max_live: int = 200_000) -> DataFrame:
    """One row a digest: its number of rows and the row that stays (most code points, then the
    smallest doc_id; a null doc_id comes after all others)."""
    local = digested.select("digest", F.lit(1).cast("long").alias("group_size"), "n_chars", "doc_id").mapInArrow(_merge(max_live, False), _GROUP)
    met = local.withColumn("prefix", F.substring("digest", 1, 2)).repartition("prefix").sortWithinPartitions("prefix").drop("prefix")
    return met.mapInArrow(_merge(max_live, True), _GROUP)


def exact_dedup(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored).

    Texts are equal when they are the same after deleting white space; null counts as empty, and
    empty texts are equal to each other. The row with the most code points stays, then the one
    with the smallest doc_id. Rows that agree in doc_id and text too each count in `group_size`;
    all of them carry `kept` where their doc_id and text are those that stay. `deleted` (doc_id,
    text) names rows that are no longer live: they are left out before the groups are made.
    """
    live = digests(docs)
    if deleted is not None:
        live = live.join(digests(deleted).select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    live = materialize(live, "digests")
    kept = groups(live)
    out = live.alias("d").join(kept.alias("g"), "digest")
    return out.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("g.keep_id").alias("keep_id"),
        F.col("g.group_size").alias("group_size"),
        (F.col("d.doc_id").eqNullSafe(F.col("g.keep_id")) & (F.col("d.n_chars") == F.col("g.n_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(translate(coalesce(text, ''), E' \t\n\x0b\x0c\r', '')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, max(n_chars) AS most FROM d GROUP BY 1
), k AS (
  SELECT d.text_sha256, min(d.doc_id) AS keep_id FROM d JOIN g ON d.text_sha256 = g.text_sha256 AND d.n_chars = g.most GROUP BY 1
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256 JOIN k ON d.text_sha256 = k.text_sha256
"""
