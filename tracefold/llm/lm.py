"""Log-probabilities of documents by a weighted backoff automaton learned from all rows.

States are the contexts of up to `order - 1` tokens that occur in training. A state has an arc for
each token that followed its context there, weighing `(c(context token) + s * p(token | shorter
context)) / (c(context) + s)`, and a failure arc to the state of the shorter context, weighing
`s / (c(context) + s)`; the root has an arc for every token, weighing its additively smoothed
share. So the weights of what can follow a state sum to one. A text is read once from left to
right: the state is carried along, failure arcs are taken until an arc fits, and the logarithms of
the weights on the way are summed.

The automaton is never in one place; each block of texts gets the part that its texts can reach.

1. Texts are dealt into blocks of about `BLOCK_BYTES`. A longer text goes on in the next block,
   with the words that its state depends on repeated ahead of it.
2. A block asks for the counts of its distinct n-grams: sorted hashes, cut into `fan` ranges, with
   its own training counts. That is `fan` rows a block at any size of the input.
3. A range sums the counts over blocks and answers each. Where a range would have more than
   `MOST_KEYS` keys, teams of about `fan` blocks first merge their keys of the range and ask as one
   block would, in `fan` finer ranges; their answers are then spread over the team. Rows stay `fan`
   for each block and level, and levels grow with the logarithm of the input.
4. A block builds states, arcs and failure arcs from the counts, and its texts traverse them, in
   lanes of `LANE` tokens that advance together. A lane inside a text first reads the `order - 1`
   tokens before it, after which its state is the one that the whole text would have led to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, is_held_out, materialize, mix, words

BLOCK_BYTES = 5 << 20
ORDER = 3
#: Weight of the shorter context, for contexts of one token, two and so on; the last one goes on.
STRENGTHS = (300.0, 5.0)
ADDED = 0.1
#: A block's keys are cut into `1 << FAN_BITS` ranges.
FAN_BITS = 7
MOST_KEYS = 6 << 20
#: Bytes of text for which a range expects one key of each length.
KEY_BYTES = 8
LANE = 512
_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_BEGIN = np.uint64(0xB0A0B0A0B0A0B0A1)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: The lowest bits of a key are the length of its n-gram; 0 is the begin of a text. The highest of
#: them is set while counting, for what is learned.
_LOW_BITS, _LENGTH_BITS, _LEARNED = np.uint64(15), np.uint64(7), np.uint64(8)
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, all first bytes first and compressed."""
    return _ZIP.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_UNZIP.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _gaps(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


# --- blocks of texts ----------------------------------------------------------------------

_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("lead", pa.int32()), ("begin", pa.bool_()), ("last", pa.bool_()), ("text", pa.binary())])


def _parts(text: bytes, most: int, order: int) -> Iterator[tuple[int, bool, bool, bytes]]:
    """(words that only lead in, whether the begin does too, whether the end follows, bytes)."""
    at, lead, begin = 0, b"", True
    while True:
        cut = at + most
        while cut < len(text) and not IS_SPACE[text[cut]]:
            cut += 1
        part = lead + text[at:cut]
        yield len(lead.split()), begin, cut >= len(text), part
        if cut >= len(text):
            return
        kept = part.rsplit(None, order - 1)[-(order - 1) :] if order > 1 else []
        kept = [w for w in kept if w.strip()]
        begin = begin and len(part.split(None, order - 1)) < order - 1 if order > 1 else False
        lead = b"".join(w + b" " for w in kept)
        at = cut


def _deal(order: int, most: int):
    """Blocks of consecutive rows as Arrow streams, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, block, size, held = part << 40, part << 32, 0, []

        def packed() -> pa.RecordBatch:
            own = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PART, strict=True)], schema=_PART)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _PART) as out:
                out.write_batch(own)
            payload = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.cast(pa.binary()).as_py()
                for lead, begin, last, own in _parts(data, most, order):
                    held.append((row, doc_id, learn, lead, begin, last, own))
                    size += len(own)
                    if size >= most:
                        yield packed()
                        block, size, held = block + 1, 0, []
                row += 1
        if held:
            yield packed()

    return run


class _Block:
    """Tokens of a block's texts and the keys of their n-grams."""

    def __init__(self, payload: bytes, order: int):
        batch = next(iter(pa.ipc.open_stream(_UNZIP.decompress(payload))))
        self.row, self.doc_id = batch.column(0), batch.column(1)
        self.learn = np.array(batch.column(2).to_pylist(), bool)
        lead = batch.column(3).to_numpy().astype(np.int64)
        begin, last = (np.array(batch.column(k).to_pylist(), bool) for k in (4, 5))
        tokens, sizes = [], []
        for w in words(batch.column(6)):
            n, b, e = np.diff(w.first), begin[w.low : w.high].astype(np.int64), last[w.low : w.high].astype(np.int64)
            size = n + b + e
            first = np.concatenate(([0], np.cumsum(size)))
            own = np.empty(first[-1], np.uint64)
            own[np.arange(len(w.hash)) + np.repeat(first[:-1] + b - w.first[:-1], n)] = w.hash
            own[first[:-1][b > 0]] = _BEGIN
            own[first[1:][e > 0] - 1] = _END
            tokens.append(own)
            sizes.append(size)
        self.sizes = np.concatenate(sizes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        tokens = np.concatenate(tokens)
        part = np.repeat(np.arange(len(self.sizes)), self.sizes)
        within = np.arange(len(tokens)) - self.first[part]
        #: Positions that are this block's own to count and score; others lead in.
        self.own = within >= (begin + lead)[part]
        self._counted = (self.own | ((within == 0) & (begin & (lead == 0))[part])) & self.learn[part]
        #: For each length the positions where an n-gram ends, and its key.
        self._at, self._keys, gram = [], [], tokens
        for k in range(order):
            if k:
                longer = np.zeros_like(gram)
                longer[1:] = mix(gram[:-1] * _STEP + tokens[1:])
                gram = longer
            here = np.flatnonzero(within >= k)
            key = (gram[here] & ~_LOW_BITS) | np.uint64(k + 1)
            if not k:
                key[begin[part] & (within == 0)] = _BEGIN & ~_LOW_BITS
            self._at.append(here)
            self._keys.append(key)

    def questions(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in ascending order and how often this block learns each."""
        keys = np.concatenate([k | self._counted[at] * _LEARNED for k, at in zip(self._keys, self._at, strict=True)])
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] & ~_LEARNED != keys[:-1] & ~_LEARNED)))
        return keys[first] & ~_LEARNED, np.add.reduceat((keys & _LEARNED) // _LEARNED, first)

    def places(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The distinct keys, how often this block learns each, and for each length the place
        among them of the n-gram that ends at a position; -1 where there is none."""
        keys, place = np.unique(np.concatenate(self._keys), return_inverse=True)
        learned = np.bincount(place, weights=np.concatenate([self._counted[at] for at in self._at]), minlength=len(keys)).astype(np.uint64)
        out, low = [], 0
        for at in self._at:
            own = np.full(len(self.own), -1, np.int32)
            own[at] = place[low : low + len(at)]
            out.append(own)
            low += len(at)
        return keys, learned, out


# --- counts over all blocks ---------------------------------------------------------------

_ASK = "source long, range long, keys binary, counts binary"
_ANSWER = "source long, range long, counts binary, tokens long, kinds long"


def _pages(source: int, above: int, depth: int, keys: np.ndarray, counts: np.ndarray, fan_bits: int) -> list[tuple]:
    """One row for each finer range of `above`, empty ones too."""
    shift = 64 - fan_bits * (depth + 1)
    edges = np.array([(above << fan_bits | k) << shift for k in range(1, 1 << fan_bits)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges), len(keys)]
    return [(source, above << fan_bits | k, _gaps(keys[a:b]), _packed(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _page_table(rows: list[tuple]) -> dict:
    return {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("source", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())))}


def _asks(order: int, fan_bits: int = FAN_BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _Block(payload.as_py(), order)
                yield pa.RecordBatch.from_pydict(_page_table(_pages(block, 0, 0, *own.questions(), fan_bits)))

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[bytes], np.ndarray]:
    """All distinct keys, the places of each page's keys there, each page's counts, and the sums."""
    lists = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
    distinct = np.sort(np.concatenate(lists))
    if len(distinct):
        distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))]
    total, places, counts = np.zeros(len(distinct), np.uint64), [], table.column("counts").to_pylist()
    for k, keys in enumerate(lists):
        places.append(np.searchsorted(distinct, keys).astype(np.int32))
        lists[k] = None
        total[places[-1]] += _unpacked(counts[k])
    return distinct, places, counts, total


def _answer_table(table: pa.Table, places: list[np.ndarray], counts: list[bytes], total: np.ndarray, tokens: int, kinds: int) -> pa.Table:
    """What a page's keys count elsewhere, which is less to send than their sums."""
    answers, n = [_packed(total[p] - _unpacked(c)) for p, c in zip(places, counts, strict=True)], len(places)
    return pa.table([table.column("source"), table.column("range"), pa.array(answers, pa.binary()), pa.array([tokens] * n, pa.int64()), pa.array([kinds] * n, pa.int64())], names=["source", "range", "counts", "tokens", "kinds"])


def _summed(table: pa.Table) -> pa.Table:
    distinct, places, counts, total = _merged(table)
    single = (distinct & _LENGTH_BITS) == 1
    return _answer_table(table, places, counts, total, int(total[single].sum()), int((total[single] > 0).sum()))


def _team_asks(depth: int, fan_bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        distinct, _, _, total = _merged(table)
        return pa.table(_page_table(_pages(key[1].as_py(), key[0].as_py(), depth, distinct, total, fan_bits)))

    return run


def _counts_of(answers: pa.Table, keys: int) -> tuple[np.ndarray, int, int]:
    """What a source's keys, in ascending order, count elsewhere; all tokens and all distinct ones."""
    by = np.argsort(answers.column("range").to_numpy(), kind="stable")
    total = np.concatenate([_unpacked(answers.column("counts")[int(k)].as_py()) for k in by])
    if len(total) != keys:
        raise RuntimeError("the answers are not those to this source's questions")
    return total, int(sum(answers.column("tokens").to_pylist())), int(sum(answers.column("kinds").to_pylist()))


def _spread(table: pa.Table, answers: pa.Table) -> pa.Table:
    distinct, places, counts, total = _merged(table)
    others, tokens, kinds = _counts_of(answers, len(distinct))
    return _answer_table(table, places, counts, total + others, tokens, kinds)


def levels_of(keys: int, most_keys: int, fan_bits: int = FAN_BITS) -> int:
    """How often ranges are made finer until none has more than about `most_keys` keys."""
    levels = 0
    while keys > most_keys << fan_bits * (levels + 1):
        levels += 1
    return levels


def totals(asks: DataFrame, sources: int, levels: int, fan_bits: int, depth: int = 0) -> DataFrame:
    """Answers (source, range, counts, tokens, kinds) to `asks`: for each page the counts of its
    keys in all other sources, with the number of all tokens and of distinct ones in the range."""
    if not levels:
        return asks.groupBy("range").applyInArrow(_summed, _ANSWER)
    asks = materialize(asks, "asks")
    teams = (sources >> fan_bits) + 1
    teamed = asks.withColumn("team", F.pmod(F.xxhash64("source", F.lit(depth)), F.lit(teams)))
    finer = teamed.groupBy("range", "team").applyInArrow(_team_asks(depth + 1, fan_bits), _ASK)
    answers = totals(finer, teams, levels - 1, fan_bits, depth + 1)
    answers = answers.withColumn("above", F.shiftright("range", fan_bits)).withColumnRenamed("source", "team")
    return teamed.groupBy("range", "team").cogroup(answers.groupBy("above", "team")).applyInArrow(_spread, _ANSWER)


# --- automaton ----------------------------------------------------------------------------


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block. A state's number is one more than
    the place of its context among the block's keys; the root is 0."""

    def __init__(self, block: _Block, answers: pa.Table, strengths: Sequence[float]):
        keys, learned, place = block.places()
        n, order = len(keys), len(place)
        begin = (keys & _LENGTH_BITS) == 0
        others, self.tokens, kinds = _counts_of(answers, n)
        self.counts = learned + others
        counts, tokens = self.counts.astype(np.float64), self.tokens
        root = np.where(begin, 1.0, (counts + ADDED) / (tokens + ADDED * (kinds + 1)))
        weight, self.fail, self.fail_weight = root.copy(), np.zeros(n + 1, np.int64), np.zeros(n + 1)
        arcs, sources, targets = [], [], []
        for k in range(order):
            at = np.flatnonzero(place[k] >= 0)
            some = np.full(n, -1, np.int64)
            some[place[k][at]] = at
            gram = np.flatnonzero(some >= 0)
            at = some[gram]  # one position where each n-gram of k + 1 tokens ends
            shorter = place[k - 1][at] if k else None
            if k:
                context = place[k - 1][at - 1]
                s = strengths[min(k, len(strengths)) - 1]
                weight[gram] = (counts[gram] + s * weight[shorter]) / (counts[context] + s)
                seen = counts[gram] > 0
                arcs.append((context[seen].astype(np.int64) + 1) * n + place[0][at[seen]])
                sources.append(gram[seen])
                targets.append(gram[seen] + 1 if k + 1 < order else shorter[seen] + 1)
            if k + 1 < order:
                s = strengths[min(k + 1, len(strengths)) - 1]
                self.fail[gram + 1] = shorter + 1 if k else 0
                self.fail_weight[gram + 1] = np.log10(s / (counts[gram] + s))
        self.n, self.order, self.token = n, order, place[0].astype(np.int64)
        self.root_target = np.where((counts > 0) & (order > 1), np.arange(n) + 1, 0)
        self.root_weight = np.log10(root)
        arcs = np.concatenate(arcs) if arcs else np.zeros(0, np.int64)
        by = np.argsort(arcs)
        self.arcs = arcs[by]
        self.target = np.concatenate(targets)[by] if targets else arcs
        self.weight = np.log10(weight[np.concatenate(sources)[by]]) if sources else np.zeros(0)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and logarithms of the weights on the way, failure arcs included."""
        weight, now, after = np.zeros(len(state)), state.copy(), np.zeros(len(state), np.int64)
        open_ = np.flatnonzero(now)
        for _ in range(self.order - 1):
            if not len(open_):
                break
            want = now[open_] * self.n + token[open_]
            at = np.searchsorted(self.arcs, want)
            found = at < len(self.arcs)
            found[found] = self.arcs[at[found]] == want[found]
            done = open_[found]
            weight[done] += self.weight[at[found]]
            after[done] = self.target[at[found]]
            now[done] = -1
            open_ = open_[~found]
            weight[open_] += self.fail_weight[now[open_]]
            now[open_] = self.fail[now[open_]]
            open_ = open_[now[open_] > 0]
        root = np.flatnonzero(now == 0)
        weight[root] += self.root_weight[token[root]]
        after[root] = self.root_target[token[root]]
        return after, weight

    def traverse(self, block: _Block, lane: int = LANE) -> np.ndarray:
        """The logarithm of each own token's weight; 0 for others."""
        out = np.zeros(len(block.own))
        token = self.token
        first, after = block.first[:-1], block.first[1:]
        lead = np.add.reduceat(~block.own, first) if len(first) else first
        begin = first + lead
        many = np.maximum(1, -((begin - after) // lane))
        part = np.repeat(np.arange(len(first)), many)
        turn = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[part] + turn * lane
        end = np.minimum(start + lane, after[part])
        low = np.where(turn == 0, first[part], np.maximum(first[part], start - (self.order - 1)))
        by = np.argsort(low - end, kind="stable")
        low, start, end = low[by], start[by], end[by]
        length = end - low
        state = np.zeros(len(low), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t, "left"))
            at = low[:k] + t
            state[:k], weight = self.step(state[:k], token[at])
            scored = at >= start[:k]
            out[at[scored]] = weight[scored]
        return out


_SCORE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(order: int, strengths: Sequence[float]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for payload in blocks.column("payload"):
            block = _Block(payload.as_py(), order)
            automaton = Automaton(block, answers, strengths)
            own, token, tokens = block.own, automaton.token, automaton.tokens
            sums = lambda x: np.add.reduceat(x, block.first[:-1])
            columns = {
                "row": block.row,
                "doc_id": block.doc_id,
                "held_out": ~block.learn,
                "n_tokens": sums(own.astype(np.int64)),
                "n_known": sums((own & (automaton.counts[token] > 0)).astype(np.int64)),
                "train_tokens": np.full(len(block.sizes), tokens),
                "base_score": sums(np.where(own, automaton.root_weight[token], 0.0)),
                "score": sums(automaton.traverse(block)),
            }
            out.append(pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in _SCORE)], schema=_SCORE))
        return pa.concat_tables(out) if out else _SCORE.empty_table()

    return run


def dealt(docs: DataFrame, learn, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts in blocks: block, payload. `docs`: (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_deal(order, block_bytes), "block long, payload binary")


def score(docs: DataFrame, learn, order: int = ORDER, strengths: Sequence[float] = STRENGTHS, block_bytes: int = BLOCK_BYTES, most_keys: int = MOST_KEYS, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns are ignored). `learn` is a
    Column that is true where a row may be learned from.

    Tokens are the lower-cased words and one end; null is an empty text, whose only token is the
    end. Repeated rows count as often as they occur; a null doc_id is carried along. Where nothing
    was learned, every token has the probability of an unknown one. Texts of any length are read
    whole. An empty table gives an empty table. `order` is 1 to 6.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = levels_of(order * size // KEY_BYTES, most_keys, fan_bits)
    blocks = dealt(docs, learn, order, block_bytes)
    if levels:  # several jobs then read the blocks
        blocks = materialize(blocks, "blocks")
    # Both the questions and the traversal start from this one exchange.
    blocks = blocks.repartition("block")
    answers = totals(blocks.mapInArrow(_asks(order, fan_bits), _ASK), size // block_bytes + 1, levels, fan_bits)
    kinds = ", ".join(f"{f.name} {t}" for f, t in zip(_SCORE, ("long", "long", "boolean", "long", "long", "long", "double", "double"), strict=True))
    parts = blocks.groupBy("block").cogroup(answers.groupBy("source")).applyInArrow(_scores(order, tuple(strengths)), kinds)
    # A text that goes on in further blocks has a row in each.
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known")),
        F.first("train_tokens").alias("train_tokens"),
        *(F.sum(c).alias(c) for c in ("base_score", "score")),
    )
    return whole.drop("row")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~is_held_out(10, 0))
