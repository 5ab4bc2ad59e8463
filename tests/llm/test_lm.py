import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.llm import lm

ROWS = [(0, "the cat sat"), (1, "The  cat ran\taway"), (2, None), (3, ""), (4, "the dog the dog"), (5, "unseen words here"), (6, "the cat sat"), (7, "z " * 3_000), (None, "the cat"), (8, "É é")]
HELD = {1, 5}




def brute_force(rows, held, order, strengths):
    """Interpolated probabilities by plain counting: doc_id -> (n_tokens, n_known, N, base, score)."""
    tokens = [(i, ["<s>", *(t or "").encode().lower().split(), None]) for i, t in rows]
    grams = Counter()
    for i, own in tokens:
        if i not in held:
            grams.update(tuple(own[a:b]) for b in range(1, len(own) + 1) for a in range(max(0, b - order), b))
    one = {g[0]: n for g, n in grams.items() if len(g) == 1 and g != ("<s>",)}
    total, kinds, out = sum(one.values()), len(one), []
    for i, own in tokens:
        base = score = 0.0
        for t in range(1, len(own)):
            p = (one.get(own[t], 0) + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p)
            for k in range(2, min(order, t + 1) + 1):
                gram, s = tuple(own[t + 1 - k : t + 1]), strengths[min(k - 1, len(strengths)) - 1]
                p = (grams[gram] + s * p) / (grams[gram[:-1]] + s)
            score += math.log10(p)
        out.append((i, i in held, len(own) - 1, sum(w in one for w in own[1:]), total, base, score))
    return out


def close(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (r[0] is None, r[0] or 0, r[6])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.mark.parametrize(("order", "block_bytes", "levels"), [(1, 4_000, 0), (2, 500, 0), (3, 60, 1), (4, 700, 2)])
def test_against_plain_counting(spark, order, block_bytes, levels):
    """Small blocks cut texts into parts; few keys make ranges finer, once and twice."""
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, score int")
    learn = ~F.coalesce(F.col("doc_id").isin(*HELD), F.lit(False))
    most_keys = order * 6_100 // lm.KEY_BYTES >> 2 * levels
    assert lm.levels_of(order * 6_100 // lm.KEY_BYTES, most_keys, 2) == levels
    close(lm.score(docs, learn, order, (5.0, 2.0), block_bytes, most_keys, 2).collect(), brute_force(ROWS, HELD, order, (5.0, 2.0)))


def test_rows_exchanged_are_in_proportion_to_blocks(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of row"), "id").alias("text")).coalesce(2)
    for many in (400, 100):
        blocks = lm.dealt(docs.limit(many), F.lit(True), 3, 200)
        assert blocks.mapInArrow(lm._asks(3), lm._ASK).count() == blocks.count() << lm.FAN_BITS
    fan = 1 << lm.FAN_BITS
    assert [lm.levels_of(n, 10) for n in (0, 10 * fan, 10 * fan + 1, 10 * fan**2, 10 * fan**2 + 1)] == [0, 0, 1, 1, 2]


def test_weights_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b a c a b"), (1, "a b")], "doc_id long, text string")
    found = {r.doc_id: 10**r.score for r in lm.score(docs, F.col("doc_id") == 0, strengths=(3.0, 2.0)).collect()}
    total, kinds = 7, 4
    p1 = lambda c: (c + 0.1) / (total + 0.1 * (kinds + 1))
    assert sum(map(p1, (3, 2, 1, 1, 0))) == pytest.approx(1.0)
    first = (1 + 3 * p1(3)) / 4
    b_after_begin_a = (1 + 2 * (2 + 3 * p1(2)) / 6) / 3
    end_after_a_b = (1 + 2 * (1 + 3 * p1(1)) / 5) / 4
    assert found[1] == pytest.approx(first * b_after_begin_a * end_after_a_b)


def test_repeated_text_is_more_likely_than_one_of_its_kind(spark):
    rng = random.Random(5)
    text = lambda: " ".join("w" + str(int(rng.paretovariate(0.7)) % 3000) for _ in range(120))
    rows = [(k, text()) for k in range(300)]
    docs = spark.createDataFrame(rows + [(1000 + k, rows[k][1]) for k in range(20)] + [(2000 + k, text()) for k in range(20)], "doc_id long, text string")
    found = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score(docs, F.col("doc_id") < 1000).collect()}
    assert min(v for k, v in found.items() if 1000 <= k < 2000) > max(v for k, v in found.items() if k >= 2000)


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score(docs, F.lit(False)).first()
    assert (r.n_known, r.train_tokens, r.held_out) == (0, 0, True) and r.base_score == pytest.approx(0.0)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
