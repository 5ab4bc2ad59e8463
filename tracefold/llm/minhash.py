"""Near duplicates: MinHash signatures, banding, verification on full sets, components.

1. A document's distinct word shingles become `BANDS * ROWS` minima of universal hashes
   `a * x + b` modulo 2**32. Equal sets form one class; only its first document goes on.
2. Classes that share a band are candidates. In a first round each band's classes are held
   against one of them, so that a band of very many copies gives a row a class. One of four
   orders of the classes, by the band's number, says which one.
3. One bit of each minimum gives an estimate that drops hopeless pairs; its margin is six
   standard deviations below the threshold. All others are confirmed on the full shingle sets,
   which are made again from the texts: a task gets a class's text and then, one at a time,
   those to hold against it. Classes with many partners are split over tasks.
4. Confirmed links give components by alternating large-star and small-star. Where the classes
   of a band are not in one component yet, those outside its largest one become queries: in
   blocks they are held against all classes of that largest component and against each other,
   until a link to a component is found or none is left to try. So each pair of classes that meets
   in a band is either compared or known to be connected, and no link that matters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialize, mix, rows, words
from .components import components

BANDS, ROWS = 40, 5
BITS = 192
_HASHES = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
_A, _B = (_HASHES[0] | np.uint32(1))[:, None], _HASHES[1][:, None]
_BAND_MIX = np.random.default_rng(8).integers(0, 1 << 63, (1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_unequal_bits(percent: int, bits: int = BITS) -> int:
    """A pair at the threshold has more unequal bits with a probability of about 1e-9."""
    p = (1 - percent / 100) / 2
    return int(bits * p + 6 * (bits * p * (1 - p)) ** 0.5) + 1


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row in ascending order: runs of `size` words, or all
    words as one run where there are fewer; none without words."""
    n = len(w.hash)
    run = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        run = mix(run * np.uint64(0x9FB21C651E98DF25) + w.hash[k : n - size + 1 + k])
    for low, high in zip(w.first[:-1], w.first[1:], strict=True):
        if high - low >= size:
            yield np.unique(run[low : high - size + 1])
        elif high > low:
            one = np.array([high - low], np.uint64)
            for h in w.hash[low:high]:
                one = mix(one * np.uint64(0x9FB21C651E98DF25) + h)
            yield one
        else:
            yield w.hash[:0]


def minima(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], block):
        np.minimum(out, (_A * x[:, k : k + block] + _B).min(axis=1), out=out)
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """For each row: the set's size and 128-bit digest, the sign bits and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for batch in batches:
            for w in words(batch.column(2)):
                many = w.high - w.low
                n, digest, signs, bands = np.zeros(many, np.int64), np.zeros((many, 2), np.int64), np.zeros((many, 3), np.int64), [None] * many
                for i, s in enumerate(shingle_sets(w, size)):
                    n[i] = len(s)
                    if not len(s):
                        continue
                    digest[i] = np.array([s.sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).view(np.int64)
                    m = minima(s)
                    signs[i] = np.packbits(mix(m[:BITS].astype(np.uint64)) & np.uint64(1) == 1).view(np.int64)
                    keys = (m.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MIX).sum(axis=1)
                    bands[i] = mix(mix(keys) + salt).view(np.int64)
                yield rows(_SKETCH, {"doc_id": batch.column(0).slice(w.low, many), "text_key": batch.column(1).slice(w.low, many), "n": n, "d0": digest[:, 0], "d1": digest[:, 1], "s0": signs[:, 0], "s1": signs[:, 1], "s2": signs[:, 2], "bands": pa.array(bands, pa.list_(pa.int64()))})

    kinds = "doc_id long, text_key long, n long, d0 long, d1 long, s0 long, s1 long, s2 long, bands array<long>"
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, kinds)


def _near(a: str, b: str, percent: int):
    """Both sizes allow the threshold and the sign bits don't rule it out."""
    unequal = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(3)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (unequal <= most_unequal_bits(percent))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, chunk: int = 500) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold. `texts`: (rep, text)."""
    pairs = materialize(pairs, "pairs")
    share = materialize(pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / chunk) + 1).alias("parts")), "parts")
    dealt = pairs.join(share, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    firsts = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("rep")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("rep")).select("a", "part", "b", "text")
    met = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            a, part, b = (batch.column(k).to_pylist() for k in range(3))
            found = []
            for w in words(batch.column(3)):
                for i, s in enumerate(shingle_sets(w, size), w.low):
                    if b[i] is None:
                        now, held = (a[i], part[i]), s
                    elif now == (a[i], part[i]):
                        both = len(np.intersect1d(held, s, assume_unique=True))
                        if 100 * both >= percent * (len(held) + len(s) - both):
                            found.append((a[i], b[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _searched(left_open: DataFrame, texts: DataFrame, size: int, percent: int, chunk: int = 256, slice_: int = 2048) -> DataFrame:
    """Links (a, b) from each class outside its family's largest component to classes of other
    components of the family, one for each component at least. `left_open`: (family, rep,
    component), where `family` is that largest component. A task gets a block of about `chunk`
    queries and a slice of about `slice_` classes of the family, however large that is."""
    queries = left_open.filter("component <> family")
    is_query = F.sum(F.when(F.col("component") != F.col("family"), 1).otherwise(0))
    dealt = left_open.groupBy("family").agg((F.floor(is_query / chunk) + 1).alias("blocks"), (F.floor(F.count(F.lit(1)) / slice_) + 1).alias("slices"))
    dealt = materialize(dealt, "blocks")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    asked = queries.join(dealt, "family").select("family", one_of("blocks", 0).alias("block"), all_of("slices").alias("slice"), F.lit(0).alias("turn"), "rep", "component")
    held = left_open.join(dealt, "family").select("family", all_of("blocks").alias("block"), one_of("slices", 1).alias("slice"), F.lit(1).alias("turn"), "rep", "component")
    met = asked.unionByName(held).join(texts, "rep").withColumn("block", F.xxhash64("block", "slice")).select("family", "block", "turn", "rep", "component", "text")
    met = met.repartition("family", "block").sortWithinPartitions("family", "block", "turn", "rep")
    hopeless = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, sets, sketch, linked, grid = None, [], [], [], [], set(), None
        for batch in batches:
            family, block, turn, rep, part = (batch.column(k).to_pylist() for k in range(5))
            found = []
            for w in words(batch.column(5)):
                for i, s in enumerate(shingle_sets(w, size), w.low):
                    if (family[i], block[i]) != now:
                        now, ids, parts, sets, sketch, linked, grid = (family[i], block[i]), [], [], [], [], set(), None
                    m = minima(s)
                    if turn[i] == 0:
                        ids.append(rep[i])
                        parts.append(part[i])
                        sets.append(s)
                        sketch.append(m)
                        continue
                    if grid is None:
                        grid = np.stack(sketch)
                    for q in np.flatnonzero((grid == m).mean(axis=1) >= hopeless):
                        n, t = len(s), sets[q]
                        if parts[q] == part[i] or (q, part[i]) in linked or 100 * min(n, len(t)) < percent * max(n, len(t)):
                            continue
                        both = len(np.intersect1d(t, s, assume_unique=True))
                        if 100 * both >= percent * (len(t) + n - both):
                            linked.add((q, part[i]))
                            found.append((ids[q], rep[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored): doc_id,
    n_shingles, component_id, kept, text_key (xxhash64 of the text, null as empty).

    Sets of `size`-word shingles of the lower-cased text are linked where
    `100 * intersection >= percent * union`. Documents without words (null, empty, white space)
    are linked with nothing. Of repeated rows each stands for itself, with the component of its
    doc_id. A row with a null doc_id links nothing: its component is null and it is kept. An
    empty table gives an empty table.
    """
    sk = materialize(sketches(docs, size), "sketches")
    named = sk.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.struct("doc_id", "text_key")
    classes = named.groupBy("d0", "d1").agg(F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "bands")))
    classes = materialize(classes.select("d0", "d1", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "n", "s0", "s1", "s2", "bands"), "classes")

    banded = classes.select("rep", "n", "s0", "s1", "s2", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("rep", F.col("band") % 4).alias("at"), "rep")
    shared = banded.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    # Tables of their own, here and below, so that Spark may split a key of very many rows in a join.
    shared = materialize(shared.select("key", F.col("first.rep").alias("leader")), "leaders")
    shared = materialize(banded.drop("band").join(shared, "key"), "bands")
    heads = classes.select("rep", "n", "s0", "s1", "s2")

    wanted = shared.select("rep").distinct().join(classes.select("rep", "text_key"), "rep")
    source = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    texts = materialize(source.join(wanted, ["rep", "text_key"]).select("rep", "text"), "texts")

    stars = shared.filter("rep <> leader").groupBy("leader", "rep").agg(*(F.first(c).alias(c) for c in ("n", "s0", "s1", "s2")))
    stars = stars.alias("y").join(heads.alias("x"), F.col("x.rep") == F.col("y.leader")).filter(_near("x", "y", percent))
    stars = stars.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    links = materialize(_confirmed(stars, texts, size, percent), "links")

    known = components(links)
    placed = shared.select("key", "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("many"))
    open_keys = sizes.groupBy("key").agg(F.max(F.struct("many", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_keys = materialize(open_keys.select("key", F.col("most.component").alias("family")), "open-keys")
    left_open = placed.join(open_keys, "key").select("family", "rep", "component").distinct()
    more = materialize(_searched(materialize(left_open, "open"), texts, size, percent), "links")
    joined = known if more.isEmpty() else components(links.unionByName(more))

    members = classes.select("d0", "d1", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("d0", "d1", F.coalesce("component", "rep").alias("component"))
    linked = named.select("doc_id", "text_key", "n", "d0", "d1").join(members, ["d0", "d1"]).select("doc_id", "text_key", "n", F.col("component").alias("component_id"))
    single = sk.filter("n = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(single).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2).drop("text_key")
