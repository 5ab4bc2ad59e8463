"""Helpers shared by the training-text operators.

`materialize` cuts lineage by a table in the cluster's shared folder; `words` finds and hashes
the words of a column of texts without making a Python object for each word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one only where that is unset and all runs on
    one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
    return _own_dir["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: later jobs, and tasks
    that run again after an executor is lost, start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- words -------------------------------------------------------------------------------

#: White space of the word rule `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows. `first[i]:first[i+1]` are the words of row `low + i`."""

    low: int
    high: int
    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def words(column: pa.Array, limit: int = 2 << 20, ends: np.ndarray = IS_SPACE) -> Iterator[Words]:
    """The lower-cased words of a text column as 64-bit hashes, for runs of rows of about
    `limit` bytes (a longer text is a run of its own), so that memory stays bounded. `ends` marks
    the bytes that are in no word."""
    offsets, data = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        a, b = int(offsets[low]), int(offsets[high])
        x = LOWER[data[a:b]]
        bounds = offsets[low : high + 1] - a
        inside = ~ends[x]
        before = np.zeros(len(x) + 1, bool)
        before[1:] = inside
        cut = np.zeros(len(x) + 1, bool)
        cut[bounds] = True
        start = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
        end = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * _power(_BASE, len(x)), out=total[1:])
        h = mix((total[end] - total[start]) * _power(_INVERSE, len(x))[start]) if len(start) else np.zeros(0, np.uint64)
        yield Words(low, high, h, np.searchsorted(start, bounds), start, end, x)
        low = high


def rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_held_out(mod: int, remainder: int, id_column: str = "doc_id"):
    """crc32 of the id as text, modulo `mod`, is `remainder`; false for a null id."""
    from pyspark.sql import functions as F

    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))
