"""Quality by nearest labelled neighbours in a latent-semantic space.

Terms are the words, lower-cased and hashed into `_WORDS` places, runs of three character classes,
words that repeat the word before them and words seen before. A bounded sample of labelled rows (`PER_LABEL` of each label, by a hash of the id) gives
the weights of the terms and, by a singular value decomposition, the latent space. Its vectors,
`2 * PER_LABEL * DIMENSIONS` floats, are broadcast; every document's vector is held against all of
them in blocks, exactly, and the `NEIGHBOURS` most alike vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, is_held_out, utf8, words

#: Bound of the sample of labelled rows that is fitted, for each label.
PER_LABEL = 1024
DIMENSIONS = 32
NEIGHBOURS = 15
_CLASSES = 16
_WORDS = 2048
_SHAPES = _CLASSES**3
_TERMS = _SHAPES + 4 + _WORDS


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    table[128:] = 5
    for k, which in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n")):
        table[[ord(c) for c in which]] = k
    for k, which in enumerate((".", ",;", "!?", "|", "*#$%&~^+=", "\"'`", "-_", "@/\\:", "()[]{}<>"), 6):
        table[[ord(c) for c in which]] = k
    return table


_CLASS = _class_table()


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Square roots of the shares of terms, for runs of rows."""
    offsets, data = utf8(column)
    for w in words(column, 1 << 20):
        many = w.high - w.low
        out = np.zeros((many, _TERMS), np.float32)
        c = _CLASS[data[offsets[w.low] : offsets[w.high]]]
        bounds = offsets[w.low : w.high + 1] - offsets[w.low]
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        for i in range(many):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= 3:
                out[i, :_SHAPES] = np.bincount(code[a : b - 2], minlength=_SHAPES) / (b - a - 2)
            out[i, _SHAPES : _SHAPES + 4] = _repeats(w, i)
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h):
                out[i, _SHAPES + 4 :] = np.bincount((h >> np.uint64(53)).astype(np.int64), minlength=_WORDS) / len(h)
        yield w.low, np.sqrt(out)


def _repeats(w: Words, i: int) -> tuple[float, float, float, float]:
    h = w.hash[w.first[i] : w.first[i + 1]]
    if not len(h):
        return 0.0, 0.0, 0.0, 0.0
    again = float((h[1:] == h[:-1]).sum()) / len(h)
    distinct = len(np.unique(h)) / len(h)
    return again, 1 - again, 1 - distinct, distinct


class Model:
    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        """`terms` is overwritten."""
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        n = len(terms)
        self.weight = np.log((1 + n) / (1 + np.count_nonzero(terms, axis=0))).astype(np.float32) + 1
        terms *= self.weight
        self.mean = terms.mean(axis=0) if n else np.zeros(_TERMS, np.float32)
        terms -= self.mean
        # The decomposition of the rows' products, which is the smaller side, has the same axes.
        value, left = np.linalg.eigh(terms @ terms.T) if n else (np.zeros(0), np.zeros((0, 0), np.float32))
        top = np.argsort(-value)[:DIMENSIONS]
        self.axes = (terms.T @ (left[:, top] / np.sqrt(np.maximum(value[top], 1e-6)))).astype(np.float32)
        self.vectors = self._unit(terms @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def project(self, terms: np.ndarray) -> np.ndarray:
        return self._unit((terms * self.weight - self.mean) @ self.axes)

    def scores(self, terms: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(terms), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        for low in range(0, len(terms) if k else 0, block):
            likeness = self.project(terms[low : low + block]) @ self.vectors.T
            near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(likeness, near, axis=1), 1e-6).astype(np.float64)
            out[low : low + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """`labels`: (doc_id, quality); a document labelled more than once takes the mean, rounded."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    picked = None
    for label in (0, 1):
        own = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = own if picked is None else picked.unionByName(own)
    # One row an id, of repeated ones that with the least hash of its text, so that the bound holds.
    text = F.coalesce("text", F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, terms in _terms(batch.column(2)):
                own = [batch.column(k).slice(low, len(terms)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in terms], pa.binary())], names=["doc_id", "quality", "terms"])

    rows = sample.select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(run, "doc_id long, quality int, terms binary").toArrow()
    ids, values = rows.column("doc_id").to_pylist(), rows.column("quality").to_pylist()
    by = sorted(range(len(ids)), key=ids.__getitem__)
    terms = np.empty((len(by), _TERMS), np.float32)
    for place, k in enumerate(by):
        terms[place] = np.frombuffer(rows.column("terms")[k].as_buffer(), np.float32)
    del rows
    return Model(terms, np.array([values[k] for k in by]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of `docs` (doc_id, text; other columns are ignored).

    Null is an empty text; texts too short for a term are scored as any other vector. Without
    labelled rows all scores are 0.5. Rows with a null or repeated doc_id stand for themselves;
    an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, terms in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(terms)), pa.array(sent.value.scores(terms))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs, train(docs, labels.filter(~is_held_out(3, 1))))
    return scored.select("doc_id", is_held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
