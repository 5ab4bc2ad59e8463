"""Training passages that copy test items: rare seeds, then Smith-Waterman alignment.

1. Runs of `SEED` words of the items, or all words of a shorter item, are looked up in all
   documents; each task sends one count of documents for each run it met. Rare runs are seeds: those
   in `RARE` documents at most, and of the others those that aren't much more frequent than the
   rarest run of some stretch of `LEAST_WORDS` words around them. So "one of the" ships no text,
   every stretch of an item keeps a seed, and an edited copy of an item that thousands copy keeps its
   own, as its runs are about as frequent as those it has lost.
2. A second pass cuts a passage around the seeds that a document holds. Both passes ask a bitmap
   first, `BITS_A_RUN` bits for each run that is looked for, which few others pass by chance; the
   exact match is a join of the passages' seeds with the items'. A benchmark of more than `MOST_RUNS`
   runs is looked for in parts.
3. Each passage is aligned with each item it shares a seed with, along the diagonals of the
   seeds, unless it has too few of the item's words for the score. A score of `threshold` of the
   item's perfect one is a copy, edited or not, if it is that of `LEAST_WORDS` words at least or of
   the whole item. The score of `LONG_WORDS` words is a copy of any longer item.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, materialize, mix, words

SEED = 3
#: Bits of a bitmap for each run in it, and how many of them a run sets: of the runs that aren't in it
#: fewer than (PLACES / BITS_A_RUN) ** PLACES, one in 4,000, pass by chance.
BITS_A_RUN, PLACES = 32, 4
#: Runs of items that one pass over the documents looks for; more items take more passes.
MOST_RUNS = 1 << 22
#: Runs in as many documents are seeds wherever they stand; a more frequent one is where no run of its
#: surroundings is `RARER` times rarer.
RARE, RARER = 64, 4
THRESHOLD = 0.5
#: An alignment scores as many words at least, or all of a shorter item.
LEAST_WORDS = 8
#: As many words, copied, are a copy of an item of any length.
LONG_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words end at white space and at ASCII punctuation.
_ENDS = IS_SPACE.copy()
_ENDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_PLACE_BITS = 32
_START = 1 << _PLACE_BITS


def _runs(w, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words and the place of each run's first word."""
    n = max(0, len(w.hash) - size + 1)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = mix(run * np.uint64(0x9FB21C651E98DF25) + w.hash[k : n + k])
    row = np.searchsorted(w.first, np.arange(n), "right") - 1
    at = np.flatnonzero(np.arange(n) + size <= w.first[row + 1])
    return run[at], at


def _runs_of(w, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each of the sizes in the order of their places, the places and the sizes."""
    met = [(*_runs(w, k), k) for k in sizes]
    runs, at = (np.concatenate([m[k] for m in met]) for k in (0, 1))
    length = np.repeat([m[2] for m in met], [len(m[1]) for m in met])
    by = np.argsort(at, kind="stable")
    return runs[by], at[by], length[by]


def _item_runs(items: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(2), ends=_ENDS):
                runs, at, length = _runs_of(w, list(range(1, size + 1)))
                row = np.searchsorted(w.first, at, "right") - 1
                keep = length == np.minimum(np.diff(w.first)[row], size)
                runs, at, length, row = runs[keep], at[keep], length[keep], row[keep]
                own = pa.array(row + w.low)
                columns = [at - w.first[row], np.diff(w.first)[row], length, runs.view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, pa.int64()) for c in columns)], names=["item_id", "item", "at", "words", "size", "run"])

    return items.mapInArrow(run, "item_id long, item long, at long, words long, size long, run long")


def _place(runs: np.ndarray, k: int, size: int) -> np.ndarray:
    return (mix(runs + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(size - 1)).astype(np.int64)


def _bitmap(runs: DataFrame) -> bytes:
    """`PLACES` bits a run; at most `MOST_RUNS` runs reach the driver."""
    own = runs.select("run").distinct().toArrow().column("run").to_numpy().view(np.uint64)
    size = 1 << max(12, (BITS_A_RUN * max(1, len(own)) - 1).bit_length())
    bits = np.zeros(size >> 3, np.uint8)
    for k in range(PLACES):
        at = _place(own, k, size)
        np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return bits.tobytes()


def _in(bitmap: np.ndarray, runs: np.ndarray) -> np.ndarray:
    left = np.arange(len(runs))
    for k in range(PLACES):  # each place is asked of those alone that the ones before let pass
        at = _place(runs[left], k, 8 * len(bitmap))
        left = left[(bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    passed = np.zeros(len(runs), bool)
    passed[left] = True
    return passed


def _seeds(runs: DataFrame, seen: DataFrame, size: int) -> DataFrame:
    """Rare runs of each item: (run, item, item_id, at, last). A run that occurs is left out only if
    each stretch of `LEAST_WORDS` words of the item around it has one that is `RARER` times rarer, so
    every such stretch keeps its rarest run and those nearly as rare."""
    around = max(0, LEAST_WORDS - size)
    order = Window.partitionBy("item", "item_id").orderBy("at")
    # Whole stretches alone: those that begin so far before the item's end, or a shorter item itself.
    whole = F.col("at") <= F.greatest(F.col("words") - size - around, F.lit(0))
    known = runs.join(seen, "run", "left").withColumn("least", F.when(whole, F.min("n_docs").over(order.rowsBetween(0, around))))
    known = known.withColumn("least", F.max("least").over(order.rowsBetween(-around, 0)))
    rare = known.filter("n_docs IS NOT NULL").filter(F.col("n_docs") <= F.greatest(F.lit(RARE), RARER * F.col("least")))
    return rare.groupBy("item", "item_id", "run").agg(F.min("at").alias("at"), F.max("at").alias("last")).select("run", "item", "item_id", "at", "last")


def _frequencies(docs: DataFrame, sent, sizes: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, met, counts = np.frombuffer(sent.value, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for w in words(batch.column(2), ends=_ENDS):
                runs, at, _ = _runs_of(w, sizes)
                hit = np.flatnonzero(_in(bitmap, runs))
                row = np.searchsorted(w.first, at[hit], "right") - 1
                once = np.unique(np.stack([row.astype(np.uint64), runs[hit]], 1), axis=0)[:, 1] if len(hit) else runs[:0]
                new, n = np.unique(once, return_counts=True)
                met, place = np.unique(np.concatenate([met, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(met)).astype(np.int64)
                if len(met) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(counts)], names=["run", "n"])
                    met, counts = met[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(counts)], names=["run", "n"])

    return docs.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n_docs"))


_PASSAGE = "doc_id long, text_key long, start long, words binary, hits array<struct<at: long, run: long>>"


def _passages(docs: DataFrame, sent, sizes: list[int], reach: int) -> DataFrame:
    """Words around the seeds of each document; seeds at most `2 * reach` apart share a passage."""
    hits_type = pa.list_(pa.struct([("at", pa.int64()), ("run", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for w in words(batch.column(2), ends=_ENDS):
                runs, at, _ = _runs_of(w, sizes)
                hit = np.flatnonzero(_in(bitmap, runs))
                if not len(hit):
                    continue
                place, row = at[hit], np.searchsorted(w.first, at[hit], "right") - 1
                cuts = np.flatnonzero((np.diff(place) > 2 * reach) | (np.diff(row) > 0)) + 1
                out: list[list] = [[], [], [], []]
                for low, high in zip([0, *cuts], [*cuts, len(hit)], strict=True):
                    own = row[low]
                    a, b = max(w.first[own], place[low] - reach), min(w.first[own + 1], place[high - 1] + max(sizes) + reach)
                    hits = [{"at": int(p - a), "run": int(r)} for p, r in zip(place[low:high], runs[hit[low:high]].view(np.int64), strict=True)]
                    for column, value in zip(out, (w.low + int(own), int(a - w.first[own]), w.hash[a:b].astype(np.uint32).tobytes(), hits), strict=True):
                        column.append(value)
                own = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], hits_type)], names=["doc_id", "text_key", "start", "words", "hits"])

    return docs.mapInArrow(run, _PASSAGE)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score, first word and end in `passage` of the best local alignment (Smith-Waterman, linear
    gaps). Each cell holds the score above the place where its alignment starts."""
    n = len(passage)
    place = np.arange(n, dtype=np.int64)
    fresh = place + 1
    slope = -GAP * _START * place
    row, best, end = fresh.copy(), 0, 0
    for word in item:
        diagonal = np.empty(n, np.int64)
        diagonal[0] = 0
        diagonal[1:] = row[:-1]
        now = diagonal + np.where(passage == word, MATCH * _START, MISMATCH * _START)
        np.maximum(now, row + GAP * _START, out=now)
        now = np.maximum.accumulate(now + slope) - slope
        row = np.maximum(now, fresh)
        at = int(row.argmax())
        if row[at] >> _PLACE_BITS > best >> _PLACE_BITS:
            best, end = int(row[at]), at + 1
    return best >> _PLACE_BITS, best & (_START - 1), end


def _needed(n: int, threshold: float) -> float:
    """The least score that makes an alignment with an item of `n` words a copy."""
    return MATCH * max(min(LEAST_WORDS, n), min(threshold * n, LONG_WORDS)) - 1e-9


def _within(item: np.ndarray, passage: np.ndarray, need: float) -> tuple[int, int]:
    """The part of `passage` outside which no alignment has the score `need`; empty if none has.
    Such an alignment has `need / MATCH` words of the item or more, and at most
    `MATCH * len(item) - need` other words, as each costs a point."""
    width = int((MATCH + 1) * len(item) - need) + 1
    total = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    start = np.arange(len(passage))
    good = np.flatnonzero(total[np.minimum(start + width, len(passage))] - total[start] >= need / MATCH)
    return (int(good[0]), min(int(good[-1]) + width, len(passage))) if len(good) else (0, 0)


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list] = [[], [], [], []]
            for k, (tokens, words_, low, high) in enumerate(zip(rows["item_words"], rows["words"], rows["low"], rows["high"], strict=True)):
                item, passage = np.frombuffer(tokens, np.uint32), np.frombuffer(words_, np.uint32)
                slack = len(item) // 2 + 8
                a, b = max(0, low - slack), min(len(passage), high + len(item) + slack)
                need = _needed(len(item), threshold)
                first, end = _within(item, passage[a:b], need)
                a, b = a + first, a + end
                if a == b:
                    continue
                score, first, end = align(item, passage[a:b])
                if score >= need:
                    for column, value in zip(out, (k, score / (MATCH * len(item)), a + first, a + end), strict=True):
                        column.append(value)
            own = pa.array(out[0], pa.int64())
            start = np.array(rows["start"], np.int64)[out[0]] if out[0] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("text_key").take(own), batch.column("item_id").take(own), pa.array(out[1], pa.float64()), pa.array(start + np.array(out[2], np.int64)), pa.array(start + np.array(out[3], np.int64))], names=["doc_id", "text_key", "item_id", "score", "first_word", "after_word"])

    return run


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), ends=_ENDS):
                own = [w.hash[a:b].astype(np.uint32).tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.low, len(own)), pa.array(own, pa.binary())], names=["item", "item_words"])

    return items.mapInArrow(run, "item long, item_words binary")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document (doc_id and text) and item of which it holds a copy: doc_id,
    item_id, score (share of the perfect score), first_word and after_word (words of the document,
    punctuation apart), text_key (xxhash64 of the text, null as empty).

    `docs`: (doc_id, text), `benchmark`: (item_id, text); other columns are ignored. Null and
    empty texts hold nothing. An item of fewer than `size` words is held by every document that has
    its words in a row; an item without words by none. Repeated rows give one row; a null id is
    kept as null. Of equal scores the first place counts. Documents and passages may have up to
    2**31 words. Empty tables give an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.lower(text).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", text).alias("item"), F.lower(text).alias("text")).distinct()
    runs = materialize(_item_runs(items, size), "runs")
    parts = -(-runs.count() // MOST_RUNS)
    if parts < 2:
        return _found(docs, items, runs, size, threshold)
    # An item and its runs belong to one part.
    of = lambda rows, k: rows.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
    return functools.reduce(DataFrame.unionByName, (_found(docs, of(items, k), of(runs, k), size, threshold) for k in range(parts)))


def _found(docs: DataFrame, items: DataFrame, runs: DataFrame, size: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    lengths = runs.groupBy("size").agg(F.max("words").alias("words")).collect()
    sizes, reach = sorted(r["size"] for r in lengths) or [size], max((r["words"] for r in lengths), default=0) * 3 // 2 + 8
    seen = _frequencies(docs, spark.sparkContext.broadcast(_bitmap(runs)), sizes)
    seeds = materialize(_seeds(runs, seen, size), "seeds")

    cut = _passages(docs, spark.sparkContext.broadcast(_bitmap(seeds)), sizes, reach)
    cut = materialize(cut.withColumn("passage", F.xxhash64("doc_id", "text_key", "start")), "passages")
    hits = cut.select("passage", F.explode("hits").alias("hit")).select("passage", F.col("hit.at").alias("place"), F.col("hit.run").alias("run"))
    low, high = F.min(F.col("place") - F.col("last")), F.max(F.col("place") - F.col("at"))
    met = hits.join(seeds, "run").groupBy("passage", "item", "item_id").agg(low.alias("low"), high.alias("high"))
    pairs = met.join(cut.select("passage", "doc_id", "text_key", "start", "words"), "passage").join(_item_words(items.select("item", "text")), "item")
    scored = pairs.select("doc_id", "text_key", "item_id", "start", "words", "item_words", "low", "high").mapInArrow(_aligned(threshold), "doc_id long, text_key long, item_id long, score double, first_word long, after_word long")
    best = F.struct("score", (-F.col("first_word")).alias("back"), "after_word")
    found = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max(best).alias("best"))
    return found.select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.back")).alias("first_word"), F.col("best.after_word").alias("after_word"), "text_key")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
