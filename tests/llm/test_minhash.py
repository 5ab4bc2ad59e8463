import random

import numpy as np

from tracefold.llm import components as cc
from tracefold.llm.minhash import near_dedup


def truth(rows, size):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(rng.choice([1, 4, 25])):
            text = list(base)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
            rows.append((n := n + 3, " ".join(text)))
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, "one"), (7, "ONE"), (8, "one two"), (10, "word " * 30_000), (11, "É x"), (13, "é x")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, size=2).collect()}
    want = truth(rows, 2)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (900, 900), (None, 3)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {n: n for e in links if None not in e for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if None not in (a, b) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert cc.components(spark.createDataFrame([], "x long, y long")).count() == 0
