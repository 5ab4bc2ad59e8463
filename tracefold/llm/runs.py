"""Periodic runs of words, found in the grammar of a document.

1. Re-Pair: pairs of symbols that recur in a document become nonterminals, the more frequent pair
   first where two overlap. A round replaces all pairs that no more frequent neighbour overlaps, in
   all documents of a chunk at once. A nonterminal's occurrences at that moment are all its places
   in the derivation. What is left of a document is the body of its start rule, read as a balanced
   binary tree, so that every boundary belongs to one rule `X -> U V`.
2. A run that is no part of U or V crosses the boundary of X. With a length of three periods and
   of `LEAST` words, one side holds half of it, so that the `LEAST // 6` words beside the boundary
   recur one period away on that side: only such distances are tried. How far a period holds on
   both sides comes from binary search over prefix hashes, within X, once a nonterminal.
3. The runs of each nonterminal are moved to all its places; intervals of one period that share a
   period's length or more are merged, and of equal intervals the smallest period stays.

Nothing is shuffled: a document is a row, and a lost task is redone from its input split. Memory
follows a chunk of documents, or one longer document: about 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rows

LEAST, POWER = 24, 3
#: Modulus and base of each prefix hash.
_HASHES = ((2147483647, 911382323), (2147483629, 972663749))
_SEED_MIX = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Grammar:
    """Rules `X -> U V` by the place of X's first occurrence: U is words `left:middle`, V is
    `middle:right`. `owner` and `place` give all places of each rule's left end."""

    left: np.ndarray
    middle: np.ndarray
    right: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def _chains(where: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: the chain of overlapping equal pairs that it is in, and its number there."""
    new = np.ones(len(where), bool)
    new[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1] + 1)
    chain = np.cumsum(new) - 1
    return chain, np.arange(len(where)) - np.flatnonzero(new)[chain]


def grammar(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> Grammar:
    """Rules of at least `least` words of consecutive documents. `first[d]:first[d + 1]` are the
    words of document d; no id is in two documents."""
    symbol, at = ids.astype(np.int64), np.arange(len(ids) + 1)
    fresh = int(ids.max(initial=0)) + 1
    maybe = np.ones(max(0, len(ids) - 1), bool)
    parts: list[tuple[np.ndarray, ...]] = []
    owners: list[tuple[np.ndarray, np.ndarray]] = []
    n_rules = 0
    while True:
        where = np.flatnonzero(maybe)
        key = symbol[where] << 32 | symbol[where + 1]
        kinds, kind = np.unique(key, return_inverse=True)
        chain, number = _chains(where, key)
        count = np.bincount(kind, weights=number % 2 == 0, minlength=len(kinds)).astype(np.int64)
        again = count[kind] > 1
        where, kind, key = where[again], kind[again], key[again]
        if not len(where):
            break
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mix(kinds.astype(np.uint64)), count))] = np.arange(1, len(kinds) + 1)
        weight = np.zeros(len(symbol) + 2, np.int64)
        weight[where + 1] = rank[kind]
        own, before, after = weight[where + 1], weight[where], weight[where + 2]
        chain, number = _chains(where, key)
        late = (before > own)[number == 0]
        taken = (number % 2 == late[chain]) & (after <= own)
        taken &= np.bincount(kind[taken], minlength=len(kinds))[kind] > 1
        place, kind = where[taken], kind[taken]

        new, kind = np.unique(kind, return_inverse=True)
        left, middle, right = at[place], at[place + 1], at[place + 2]
        long = np.flatnonzero(right - left >= least)
        if len(long):
            rules, one, owner = np.unique(kind[long], return_index=True, return_inverse=True)
            one = long[one]
            parts.append((left[one], middle[one], right[one]))
            owners.append((owner + n_rules, left[long]))
            n_rules += len(rules)
        stays = np.ones(len(symbol), bool)
        stays[place + 1] = False
        changed = np.zeros(len(symbol), bool)
        changed[where] = True
        changed[place] = True
        changed[place[place > 0] - 1] = True
        symbol[place] = fresh + kind
        fresh += len(new)
        symbol, at, maybe = symbol[stays], at[np.append(stays, True)], changed[stays][:-1]

    # The start rules: the boundary before a document's j-th symbol is that of the node over
    # the symbols j - low .. j + low, low being the lowest bit of j.
    head = np.searchsorted(at[:-1], first)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(head))
    j = np.arange(len(symbol)) - head[doc]
    low = j & -j
    inner = j > 0
    j, doc, low = np.flatnonzero(inner), doc[inner], low[inner]
    left, right = at[j - low], at[np.minimum(j + low, head[doc + 1])]
    long = right - left >= least
    left, middle, right = left[long], at[j[long]], right[long]
    parts.append((left, middle, right))
    owners.append((n_rules + np.arange(len(left)), left))
    return Grammar(*(np.concatenate([p[k] for p in parts]) for k in range(3)), *(np.concatenate([o[k] for o in owners]) for k in range(2)))


class _Prefixes:
    """Prefix hashes of a sequence of ids, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.tables = []
        value = mix(ids.astype(np.uint64))
        for modulus, base in _HASHES:
            power = np.ones(len(ids) + 1, np.int64)
            have, step = 1, base
            while have < len(power):
                power[have : 2 * have] = power[:have][: len(power) - have] * step % modulus
                have, step = 2 * have, step * step % modulus
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum((value % np.uint64(modulus)).astype(np.int64) * power[:-1] % modulus, out=sums[1:])
            self.tables.append((modulus, power, sums))

    def equal(self, i: np.ndarray, period: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on are those from i + period on."""
        same = np.ones(len(i), bool)
        for modulus, power, sums in self.tables:
            here = (sums[i + n] - sums[i]) % modulus * power[period] % modulus
            j = i + period
            same &= here == (sums[j + n] - sums[j]) % modulus
        return same

    def agree(self, i: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest n up to `most` with equal words from i on (before i, if `back`)."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.equal(i - n if back else i, period, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


def _smallest(rule: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal intervals of a rule the one of smallest period."""
    by = np.lexsort((period, end, start, rule))
    rule, start, end, period = rule[by], start[by], end[by], period[by]
    one = np.ones(len(rule), bool)
    one[1:] = (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return rule[one], start[one], end[one], period[one]


def _crossing(ids: np.ndarray, g: Grammar, least: int, power: int, chunk: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the runs across each rule's boundary, inside its words."""
    seed = max(1, least // 6)
    n = len(ids) - seed + 1
    nothing = np.zeros((4, 0), np.int64)
    if n < 2 or not len(g.left):
        return tuple(nothing)
    gram = np.zeros(n, np.uint64)
    for k in range(seed):
        gram = mix(gram * _SEED_MIX + ids[k : n + k].astype(np.uint64))
    order = np.argsort(gram, kind="stable")
    new = np.ones(n, bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    group, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    sorted_group = np.cumsum(new) - 1
    group[order] = sorted_group
    rank[order] = np.arange(n)
    key = sorted_group * n + order

    found, prefixes = [], None
    for ahead in (True, False):
        # The seed stands just after the boundary, or just before it; its other places inside
        # the rule's half on that side are one period away.
        seat = g.middle if ahead else g.middle - seed
        rule = np.flatnonzero((seat < n) & (seat >= 0) & ((g.right - g.middle if ahead else g.middle - g.left) >= least // 2))
        seat = seat[rule]
        if ahead:
            low, high = rank[seat] + 1, np.searchsorted(key, group[seat] * n + g.right[rule] - seed, "right")
        else:
            low, high = np.searchsorted(key, group[seat] * n + g.left[rule], "left"), rank[seat]
        many = np.maximum(high - low, 0)
        rule, low, many = rule[many > 0], low[many > 0], many[many > 0]
        ends = np.cumsum(many)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, chunk):
            flat = np.arange(begin, min(begin + chunk, int(ends[-1])))
            of = np.searchsorted(ends, flat, "right")
            other = order[low[of] + flat - (ends[of] - many[of])]
            r = rule[of]
            left, middle, right = g.left[r], g.middle[r], g.right[r]
            period = other - middle if ahead else middle - seed - other
            fits = power * period <= right - left
            r, left, middle, right, period = r[fits], left[fits], middle[fits], right[fits], period[fits]
            if not len(r):
                continue
            prefixes = prefixes or _Prefixes(ids)
            base = middle if ahead else middle - period
            start = base - prefixes.agree(base, period, base - left, back=True)
            end = base + period + prefixes.agree(base, period, right - base - period)
            good = (end - start >= np.maximum(least, power * period)) & (start < middle) & (end > middle)
            found.append(_smallest(r[good], start[good], end[good], period[good]))
    if not found:
        return tuple(nothing)
    return _smallest(*(np.concatenate([f[k] for f in found]) for k in range(4)))


def runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """All runs of consecutive documents (see `grammar`): rows (start, end, period) by start, then
    period; starts and ends are places in `ids`."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    g = grammar(ids, first, least)
    rule, start, end, period = _crossing(ids, g, least, power)
    # To all places of each rule.
    by = np.argsort(g.owner, kind="stable")
    owner, place = g.owner[by], g.place[by]
    low, high = np.searchsorted(owner, rule, "left"), np.searchsorted(owner, rule, "right")
    many = high - low
    shift = place[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] - np.repeat(g.left[rule], many)
    start, end, period = np.repeat(start, many) + shift, np.repeat(end, many) + shift, np.repeat(period, many)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    # Intervals of one period that share a period are parts of one run.
    by = np.lexsort((start, period))
    start, end, period = start[by], end[by], period[by]
    lane = np.cumsum(np.append(True, period[1:] != period[:-1])) * (len(ids) + 1)
    reach = np.maximum.accumulate(end + lane)
    new = np.append(True, start[1:] + lane[1:] > reach[:-1] - period[1:])
    head = np.flatnonzero(new)
    start, period, end = start[head], period[head], np.maximum.reduceat(end, head)
    # Of equal intervals the smallest period.
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    out = np.stack([start[one], end[one], period[one]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


# --- over a table --------------------------------------------------------------------------

SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("periods", pa.list_(pa.int64())), ("collapsed_sha256", pa.string())])


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the contract's rule repeats in a tenth of all documents; other documents, and
    those with a null id, stay as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _numbered(words: list[bytes], base: int) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base


def periodic_runs(docs: DataFrame, rewrite=None, least: int = LEAST, power: int = POWER, chunk_words: int = 1 << 18) -> DataFrame:
    """For each row of `docs` (doc_id, text; other columns are ignored): its words' number, its
    runs (start, length and period by start, then period) and the SHA-256 of the words that stay,
    joined by one space, when a run keeps its first period only.

    A run is a longest stretch of words of smallest period q, with at least `power * q` and `least`
    words. Words are parted by white space; letters' case counts. Null or empty text has no words
    and no runs. `rewrite(doc_id, words)` may replace a document's words first. Rows with a null or
    repeated doc_id each stand for themselves. An empty table gives an empty table.
    """

    def finish(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        first = np.cumsum([0, *(len(w) for _, w in held)])
        ids = np.concatenate([np.zeros(0, np.int64), *(_numbered(w, int(b)) for (_, w), b in zip(held, first[:-1], strict=True))])
        all_runs = runs(ids, first, least, power)
        cut = np.searchsorted(all_runs[:, 0], first)
        out: dict[str, list] = {f.name: [] for f in _ARROW}
        for (doc_id, words), low, high, base in zip(held, cut[:-1], cut[1:], first[:-1], strict=True):
            own = all_runs[low:high] - [base, base, 0]
            if len(own):
                keep = np.ones(len(words) + 1, np.int64)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, own[:, 0] + own[:, 2], 1)
                np.add.at(gone, own[:, 1], -1)
                keep = np.cumsum(gone)[:-1] == 0
                words = [words[i] for i in np.flatnonzero(keep)]
            values = (doc_id, len(keep) if len(own) else len(words), own[:, 0].tolist(), (own[:, 1] - own[:, 0]).tolist(), own[:, 2].tolist(), hashlib.sha256(b" ".join(words)).hexdigest())
            for f, v in zip(_ARROW, values, strict=True):
                out[f.name].append(v)
        return rows(_ARROW, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if rewrite:
                    words = rewrite(doc_id, words)
                held.append((doc_id, words))
                size += len(words) + 16
                if size >= chunk_words:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def with_digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one of greatest exponent (then smallest start, then period), and
    digests of all runs."""
    each = F.arrays_zip("starts", "lengths", "periods")
    # length / period, compared exactly: a / b > c / d where a * d > c * b.
    best = F.aggregate(each, F.lit(None).cast("struct<starts:long,lengths:long,periods:long>"), lambda a, b: F.when(a.isNull() | (b["lengths"] * a["periods"] > a["lengths"] * b["periods"]), b).otherwise(a))
    lines = F.transform(each, lambda r: F.concat(r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","), r["periods"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("starts").cast("long").alias("n_runs"),
        F.col("best.starts").alias("start"),
        F.col("best.lengths").alias("length"),
        F.col("best.periods").alias("period"),
        F.expr("best.lengths * 1000L div best.periods").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return with_digest(periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=looped))
