import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import runs

TABLE = "/root/testdata/sf0.001/documents.parquet"


def plain_runs(words, least=24, power=3):
    """Every stretch that keeps a period, for each period; of equal stretches the smallest one."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, best = np.array([names[w] for w in words], np.int64), {}
    for p in range(1, len(x) // power + 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b + p - a >= max(least, power * p):
                best.setdefault((int(a), int(b) + p), p)
    return sorted(((s, e, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def found(docs, least):
    first = np.cumsum([0, *map(len, docs)])
    ids = np.concatenate([np.zeros(0, np.int64), *(np.array(d, np.int64) + 100 * i for i, d in enumerate(docs))]).astype(np.int64)
    return [tuple(map(int, r)) for r in runs.runs(ids, first, least)]


def expected(docs, least):
    out, base = [], 0
    for d in docs:
        out += [(s + base, e + base, p) for s, e, p in plain_runs(d, least)]
        base += len(d)
    return out


block = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 40)).map(lambda x: (x[0] * 40)[: x[1]])
document = st.lists(block, max_size=6).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=300, deadline=None)
@given(st.lists(document, max_size=3), st.sampled_from([6, 12, 24]))
def test_runs_are_those_of_brute_force(docs, least):
    assert found(docs, least) == expected(docs, least)


def test_words_that_repeat_without_runs():
    thue = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    for word in (thue, b, list(range(50)) * 2):
        assert found([word], 24) == plain_runs(word)


@pytest.mark.parametrize(("words", "more"), [([0] * 70_000, 0), ([0, 1] * 30_000, 0), ([i % 1000 for i in range(50_000)], 0), (([0] * 30 + [1]) * 900, 900)])
def test_long_runs_are_found_whole(words, more):
    got = found([words], 24)
    assert got[0][:2] == (0, 30) if more else got[0][:2] == (0, len(words))
    assert len(got) == 1 + more and max(e - s for s, e, _ in got) == len(words)


def plain_row(doc_id, text):
    words = runs.looped(doc_id, text.encode().split()) if text else []
    own = plain_runs(words)
    best = min(own, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if own else None
    gone = {i for s, e, p in own for i in range(s + p, e)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in own)
    row = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(own), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_over_the_table(spark):
    rows = spark.read.parquet(TABLE).select("doc_id", "text").collect()
    got = sorted(map(tuple, runs.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5


def test_edges_of_the_table(spark):
    loop = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t ", 1), (None, "a b " * 30, 1), (5, "A a " * 20, 1), (5, "A a " * 20, 1), (6, "x y " * 24, 1), (loop, "one", 1), (loop, " ".join(map(str, range(400))), 1), (7, "w " * 100_000, 1), (8, ("u " * 12 + "v ") * 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs long")
    got = runs.with_digest(runs.periodic_runs(docs, rewrite=runs.looped, chunk_words=50))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if r[0] != 7]
    assert sorted((tuple(r) for r in got.collect() if r[0] != 7), key=key) == sorted((plain_row(*r[:2]) for r in small), key=key)
    assert tuple(got.filter("doc_id = 7").first())[:6] == (7, 1, 0, 100_000, 1, 100_000_000)
    assert got.filter("false").count() == runs.with_digest(runs.periodic_runs(docs.filter("doc_id = 99"))).count() == 0
    same = runs.with_digest(runs.periodic_runs(docs, rewrite=runs.looped, chunk_words=1 << 18)).collect()
    assert sorted(map(tuple, same), key=key) == sorted(map(tuple, got.collect()), key=key)


def test_ties_go_to_the_smallest_start(spark):
    text = " ".join(["a b c"] * 9 + ["x"] + ["d e f"] * 9)
    row = runs.with_digest(runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 27, 3, 9000)


def test_random_documents_in_chunks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + " p q" * rng.randint(0, 30)) for i in range(300)]
    got = runs.with_digest(runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), rewrite=runs.looped, chunk_words=700))
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)
