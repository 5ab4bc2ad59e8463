"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts hashed 4-byte windows and scripts per language over all rows that may be learned
from; each task sends one count a language and window. The model is `WINDOWS` floats a language,
so its size is that of the languages' number; each language sends one row to the driver.

A word's scripts leave the languages that use them; its score for each is the sum of its windows'
log-odds. Viterbi over the words of a document, all documents of a chunk in step, charges
`penalty` for each change of language; words without letters carry no evidence. The document's
language is the one that labels most bytes of words, its score that share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, LOWER, fresh, is_held_out, utf8

WINDOWS = 1 << 16
UNKNOWN = "und"
#: Code points of scripts, first to last. Fixed values.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def _script_bits() -> np.ndarray:
    """Bit of the script by the first two bytes of a letter."""
    bits = np.zeros((256, 256), np.uint16)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            for c in filter(lambda c: chr(c).isalpha(), range(first, last + 1)):
                b = chr(c).encode()
                if len(b) == 1:
                    bits[b[0], :] |= np.uint16(1 << k)
                else:
                    bits[b[0], b[1]] |= np.uint16(1 << k)
    return bits


_BITS = _script_bits()


@dataclass
class Chunk:
    """Lower-cased bytes of rows `low` to `high`, a space after each; `bounds[i]:bounds[i+1]`."""

    low: int
    high: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[Chunk]:
    offsets, data = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        a, b = int(offsets[low]), int(offsets[high])
        bounds = offsets[low : high + 1] - a + np.arange(high - low + 1)
        out = np.full(b - a + high - low, 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = LOWER[data[a:b]]
        yield Chunk(low, high, out, bounds)
        low = high


def windows(x: np.ndarray) -> np.ndarray:
    """Bucket of the 4 bytes from the one before each position."""
    p = np.full(len(x) + 3, 32, np.uint32)
    p[1:-2] = x
    w = p[:-3] | p[1:-2] << np.uint32(8) | p[2:-1] << np.uint32(16) | p[3:] << np.uint32(24)
    return (w * np.uint32(0x9E3779B1)) >> np.uint32(32 - 16)


def script_bits(x: np.ndarray) -> np.ndarray:
    return _BITS[x, np.append(x[1:], np.uint8(32))]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # windows x languages, log-odds
    scripts: np.ndarray  # bits of the scripts each language uses


_COUNTS = "lang string, kind int, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for c in chunks(batch.column(1)):
            w, s = windows(c.data), script_bits(c.data)
            inside = ~IS_SPACE[c.data]
            owner = np.repeat(np.arange(c.high - c.low), np.diff(c.bounds))
            names, code = np.unique(langs[c.low : c.high].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                if name not in held:
                    held[name] = [np.zeros(WINDOWS, np.int64), np.zeros(len(SCRIPTS), np.int64)]
                own = code[owner] == k
                held[name][0] += np.bincount(w[own & inside], minlength=WINDOWS)
                held[name][1] += [int(((s[own] >> np.uint16(j)) & np.uint16(1)).sum()) for j in range(len(SCRIPTS))]
    for name, arrays in held.items():
        for kind, counts in enumerate(arrays):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "kind", "bucket", "n"])


def _dense(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The counts of one language, of which there are `WINDOWS` and one a script at most."""
    kind, bucket, n = (table.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    arrays = [np.zeros(WINDOWS, np.int64), np.zeros(len(SCRIPTS), np.int64)]
    for k, own in enumerate(arrays):
        own[bucket[kind == k]] = n[kind == k]
    return pa.table({"lang": [key[0].as_py()], "windows": [arrays[0].tobytes()], "scripts": [arrays[1].tobytes()]})


def train(docs: DataFrame, least_script_share: float = 0.01) -> Model:
    """A model of all rows of `docs` (text, lang) in which neither is null. Only its table reaches
    the driver: a row of `WINDOWS + scripts` counts for each language."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInArrow(_count, _COUNTS)
    counted = rows.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    got = sorted((r.lang, r.windows, r.scripts) for r in counted.groupBy("lang").applyInArrow(_dense, "lang string, windows binary, scripts binary").collect())
    languages = [name for name, _, _ in got]
    table = np.zeros((WINDOWS, len(languages)), np.float32)
    scripts = np.zeros(len(languages), np.uint16)
    for k, (_, w, sc) in enumerate(got):
        table[:, k] = np.frombuffer(w, np.int64)
        n = np.frombuffer(sc, np.int64)
        scripts[k] = sum(1 << int(b) for b in np.flatnonzero((n > 0) & (n >= least_script_share * max(1, n.sum()))))
    table = np.log((table + 0.5) / (table.sum(axis=0, dtype=np.float64) + 0.5 * WINDOWS)) if languages else table
    table = table - table.mean(axis=1, keepdims=True) if languages else table
    return Model(languages, table.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; documents `first[i]:first[i+1]` advance together by position."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    at, sizes = first[:-1][order], lengths[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), "right")
    came = np.zeros(len(scores), np.uint16)
    switched = np.zeros(scores.shape, bool)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(most):
        k = active[t]
        word = at[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            by_change = v[np.arange(k), best] - penalty
            change = by_change[:, None] > v
            came[word], switched[word] = best, change
            np.maximum(v, by_change[:, None], out=v)
        v += scores[word]
    label = np.zeros(len(scores), np.uint16)
    now = value.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        k = active[t]
        word = at[:k] + t
        label[word] = now[:k]
        if t:
            now[:k] = np.where(switched[word, now[:k]], came[word], now[:k])
    return label


def _label(chunk: Chunk, model: Model, penalty: float, texts: pa.Array):
    """Language, score and spans of each row of the chunk."""
    x, many, n_lang = chunk.data, chunk.high - chunk.low, len(model.languages)
    inside = ~IS_SPACE[x]
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, chunk.bounds)
    if len(start):
        cuts = np.minimum(np.stack([start, end], 1).ravel(), len(x) - 1)
        scores = np.add.reduceat(model.table[windows(x)], cuts, axis=0)[::2]
        bits = np.bitwise_or.reduceat(script_bits(x), cuts)[::2]
        fits = (bits[:, None] & model.scripts[None, :]) > 0
        scores = np.where(fits | ~fits.any(axis=1, keepdims=True), scores, np.float32(-50.0))
        scores[bits == 0] = 0
        label = viterbi(scores, first, penalty)
    else:
        bits, label = np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    size = (end - start) * (bits > 0)
    owner = np.repeat(np.arange(many), np.diff(first))
    held = np.bincount(owner * n_lang + label, weights=size, minlength=many * n_lang).reshape(many, n_lang)
    total = held.sum(axis=1)
    best = held.argmax(axis=1)
    change = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])))) if len(label) else np.zeros(0, int)
    stop = np.append(change[1:], len(label)) if len(change) else change
    spans: list[list] = [[] for _ in range(many)]
    for a, b in zip(change, stop, strict=True):
        i = int(owner[a])
        spans[i].append({"first_word": int(a - first[i]), "after_word": int(b - first[i]), "lang": model.languages[label[a]]})
    names, score = [], np.divide(held[np.arange(many), best], total, out=np.zeros(many), where=total > 0)
    for i in range(many):
        known = any(c.isalpha() for c in texts[chunk.low + i].as_py() or "")
        names.append(model.languages[best[i]] if known else UNKNOWN)
        if not known:
            spans[i] = []
    return names, score, spans


_SPAN = pa.list_(pa.struct([("first_word", pa.int32()), ("after_word", pa.int32()), ("lang", pa.string())]))


_FOUND = "lang_pred string, score double, spans array<struct<first_word: int, after_word: int, lang: string>>"


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and spans (first_word, after_word, lang) of every row of `docs`
    (doc_id, text). With `keep`, the columns of `docs`, then a struct of the others, under the
    first free name of `__found`, `___found` and so on.

    Null texts and texts without a letter are `und` with score 0 and no spans; so is all where
    nothing was learned. Letters of a script that no language uses give the first language. Rows
    with a null or repeated doc_id stand for themselves; ties go to the language first in the
    alphabet; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name = fresh("__found", rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StructType.fromDDL(_FOUND))])
    at = rows.columns.index("text")
    kinds = [pa.string(), pa.float64(), _SPAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for c in chunks(batch.column(at)):
                many = c.high - c.low
                found = _label(c, model, penalty, batch.column(at)) if model.languages else ([UNKNOWN] * many, np.zeros(many), [[]] * many)
                found = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=["lang_pred", "score", "spans"])
                own = batch.slice(c.low, many)
                yield pa.RecordBatch.from_arrays([*own.columns, found], names=[*batch.schema.names, name])

    out = rows.mapInArrow(run, schema)
    return out if keep else out.select("doc_id", f"{name}.*")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.filter(~is_held_out(4, 2))))
    return found.select("doc_id", is_held_out(4, 2).alias("held_out"), "lang_pred", "score")
