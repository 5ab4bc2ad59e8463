"""Variants of spelling: words one edit apart, by asymmetric chunks.

1. Tasks count the words of their rows; a shuffle of (word, count) adds the counts up.
2. A word is parted into two disjoint chunks. One edit leaves a chunk whole, and in the longer of
   two words, or of two equally long ones, the chunk stands at its own place or one further on: the
   shorter word gives its chunks, the longer one those of its positional grams that stand within
   this shift of a chunk of a word with its own length or one less. Equal ones meet. The rest of the
   word, which holds the edit, is parted again in the same way, `depth` times in all, so that words
   with a common beginning or end don't all meet: a key is what stands before and behind a hole.
3. What meets is verified by edit distance. A pair that meets in several holes counts in the last.
4. A word's form is its most frequent near word, where that is at least twice as frequent. Forms
   lead on to forms; roots come from doubling the links, so that rounds follow the logarithm of the
   longest chain, which is itself one of the counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, utf8

#: Leading byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def lower_words(data: np.ndarray) -> list[bytes]:
    """Runs of `[A-Za-z\\u00C0-\\u00FF]` of UTF-8 bytes, A-Z lower-cased."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return np.where(inside, LOWER[data], np.uint8(32)).tobytes().split()


def misspelt(doc_id: int | None, words: list[bytes], total: Counter) -> None:
    """Counts words after the contract's rule, which deletes a letter from some of a document's
    words. Words of a null doc_id stay as they are."""
    total.update(words)
    if doc_id is None:
        return
    head = zlib.crc32(f"{doc_id}:".encode())
    for word in set(words):
        h = zlib.crc32(word, head)
        if h % 97 == 0:
            n = words.count(word)
            text = word.decode()
            k = h % len(text)
            total[word] -= n
            total[(text[:k] + text[k + 1 :]).encode()] += n


def word_counts(docs: DataFrame, count=None, shortest: int = 5, least: int = 3, held: int = 200_000) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur at least `least` times
    in `docs` (doc_id, text). `count(doc_id, words, counter)` may count other words than the text's.
    A task holds about `held` words."""

    def out(total: Counter) -> pa.RecordBatch:
        kept = [(word.decode(), n) for word, n in total.items() if n > 0]
        kept = [x for x in kept if len(x[0]) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                words = lower_words(data[offsets[i] : offsets[i + 1]])
                if count:
                    count(doc_id, words, total)
                else:
                    total.update(words)
                if len(total) > held:
                    yield out(total)
                    total = Counter()
        yield out(total)

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _holes(length, depth: int) -> list[tuple]:
    """(first, end) of the parts into which `depth` halvings cut a word of `length` letters."""
    parts = [(F.lit(0), length)]
    for _ in range(depth):
        halves = [(low, low + F.ceil((high - low) / 2).cast("int"), high) for low, high in parts]
        parts = [x for low, middle, high in halves for x in ((low, middle), (middle, high))]
    return parts


def _keys(words: DataFrame, longer: int, depth: int) -> DataFrame:
    """A row for each word and hole: `key` of what a word of its length less `longer` has around
    the hole, the hole's end, and whether it is the last one."""
    length = F.char_length("word") - longer
    around = [
        F.struct(
            F.xxhash64(F.lit(k), length, low, high, F.substring("word", F.lit(1), low), F.substring("word", high + longer + 1, length)).alias("key"),
            high.cast("int").alias("end"),
            F.lit(k == (1 << depth) - 1).alias("last"),
        )
        for k, (low, high) in enumerate(_holes(length, depth))
    ]
    return words.select("word", "n", F.explode(F.array(*around)).alias("at")).select("at.key", "at.end", "at.last", "word", "n")


def near_pairs(words: DataFrame, depth: int = 2) -> DataFrame:
    """Each pair of `words` (word, n) that one inserted, deleted or replaced code point parts:
    (a, n_a, b, n_b), `a` the shorter or of equal lengths the smaller one."""
    a = _keys(words, 0, depth).toDF("key", "end", "last", "a", "n_a")
    b = _keys(words, 0, depth).withColumn("longer", F.lit(0)).unionByName(_keys(words, 1, depth).withColumn("longer", F.lit(1)))
    b = b.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    met = a.join(b, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    # The next hole meets too where both agree up to this one's end.
    last = F.col("last") | (F.expr("left(a, end)") != F.expr("left(b, end)"))
    return met.filter(last & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def with_roots(linked: DataFrame) -> DataFrame:
    """(word, form) with the last word that forms lead to as `root`. Forms must not run in rings."""
    links = materialize(linked.select("word", "form", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if not links.filter("moved").limit(1).count():
            return links.select("word", "form", "root")


def spelling_variants(docs: DataFrame, count=None, shortest: int = 5, least: int = 3, times: int = 2, depth: int = 2) -> DataFrame:
    """A row for each word of `docs` (doc_id, text; other columns are ignored), see `word_counts`:
    word, n, form (its near word of largest n, of equal ones the smallest, where that n is at least
    `times` its own; else null), root (the last word that forms lead to, itself without one), n_near
    and form_n.

    Null or empty text has no words. Rows with a null or repeated doc_id each count. An empty table
    gives an empty table.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    words = materialize(word_counts(docs, count, shortest, least), "words")
    pairs = near_pairs(words, depth)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    each = pairs.select(ends.alias("e")).select("e.word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("e.near_n")).alias("less"), F.col("e.near").alias("near")).alias("best"))
    own = words.select("word", "n", F.lit(None).cast("struct<less:long,near:string>").alias("best"))
    of = own.unionByName(each).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    of = materialize(of.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = with_roots(of.filter("form IS NOT NULL")).select("word", "root")
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), count=misspelt)


_NEXT = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
#: The checksum's table, then words by the deletions that they share.
OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: {_NEXT}) AS c FROM range(256) r(n))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
d AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT doc_id, w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::BIGINT[] AS bytes FROM d),
h AS (SELECT doc_id, w, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) END AS h FROM b, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
x AS MATERIALIZED (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
f AS MATERIALIZED (SELECT p.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS best, max(v.n) AS best_n FROM p JOIN v ON v.word = near GROUP BY 1),
o AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
c AS (SELECT word, word AS at, form AS next FROM o UNION ALL SELECT c.word, o.word, o.form FROM c JOIN o ON o.word = c.next)
SELECT o.word, o.form, c.at AS root, o.n, o.n_near, o.form_n FROM o JOIN c ON c.word = o.word AND c.next IS NULL
"""
