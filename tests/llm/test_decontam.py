import itertools
import random

import numpy as np

from tracefold.llm import decontam


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))


def test_copies_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(9)
    items = [[word(rng) for _ in range(40)] for _ in range(30)]
    common = ["of", "the", "and", "to"]
    fill = lambda n: [rng.choice([word(rng), rng.choice(common)]) for _ in range(n)]
    docs, want = [], set()
    for k in range(120):
        text = fill(150)
        if k % 3 == 0:
            i = k % 30 if k < 60 else 0
            copy = list(items[i])
            for _ in range(rng.randrange(7)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word(rng)], [copy[at], word(rng)]])
            text[70:70] = [w.upper() + "," for w in copy]
            want.add((k, i))
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "to be"), (502, "to be"), (None, " ".join(items[3])), (503, " ".join(fill(40_000) + items[4]))]
    want |= {(None, 3), (503, 4)}
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(100, None), (101, ""), (103, "of the and to of the and")]
    found = decontam.contaminated(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, words int"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    whole = next(r for r in found if r.doc_id == 503)
    assert (whole.score, whole.first_word, whole.after_word) == (1.0, 40_000, 40_040)


def test_only_copies_are_edited_or_lie_in_a_common_half(spark):
    rng = random.Random(5)
    items = [[word(rng) for _ in range(40)] for _ in range(6)] + [[word(rng) for _ in range(20)] for _ in range(6)] + [[word(rng) for _ in range(300)]]
    fill = lambda n: [word(rng) for _ in range(n)]
    docs, want = [], set()
    for i, item in enumerate(items[:12]):
        copy = [word(rng) if at % 7 == 3 else w for at, w in enumerate(item)]
        docs.append((i, fill(60) + copy + fill(60)))
        want.add((i, i))
    hot = [word(rng) for _ in range(40)]
    items.append(hot)
    docs += [(100 + k, fill(20) + hot[:24] + fill(20)) for k in range(40)] + [(200, fill(20) + hot + fill(20))]
    want |= {(100 + k, 13) for k in range(40)} | {(200, 13)}
    docs += [(300, fill(30) + items[12][100:180] + fill(30)), (301, fill(30) + items[12][100:120] + fill(30))]
    want.add((300, 12))
    # The hot item's words in another order share no alignment.
    docs.append((400, fill(9) + [w for k in range(0, 40, 3) for w in hot[k : k + 3][::-1]] + fill(9)))
    found = decontam.contaminated(spark.createDataFrame([(k, " ".join(x)) for k, x in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def plain(docs, bench):
    """Copies by alignment of every document with every item."""
    import pyarrow as pa

    def hashed(texts):
        out = []
        for w in decontam.words(pa.array([t.lower() if t else "" for t in texts]), ends=decontam._ENDS):
            out += [w.hash[a:b].astype(np.uint32) for a, b in itertools.pairwise(w.first)]
        return out

    found = set()
    items = list(zip([i for i, _ in bench], hashed([t for _, t in bench]), strict=True))
    for (doc_id, _), passage in zip(docs, hashed([t for _, t in docs]), strict=True):
        for item_id, item in items:
            need = decontam._needed(len(item), decontam.THRESHOLD)
            if len(item) and len(passage) and np.isin(item, passage).sum() * decontam.MATCH >= need and decontam.align(item, passage)[0] >= need:
                found.add((doc_id, item_id))
    return found


def test_query_against_alignment_of_all_pairs(spark):
    rows = lambda name: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.op10_decontamination(spark, "/root/testdata/sf0.001").collect()}
    want = plain(rows("documents"), rows("benchmark"))
    assert got <= want and len(got) >= 0.9 * len(want) and want


def test_rare_seeds_lose_no_copy_among_very_many(spark):
    rng = random.Random(11)
    common = [" ".join(rng.sample(["one", "of", "the", "and", "in", "to", "a"], 3)) for _ in range(6)]
    phrase = lambda n: [x for _ in range(n) for x in (word(rng), word(rng), *rng.choice(common).split())]
    items = [phrase(8) for _ in range(12)]
    docs = []
    for k in range(300):  # the first item is copied by very many, whole and edited
        copy = list(items[0])
        if k % 3 == 0:
            copy = [word(rng) if at % 6 == k % 6 else w for at, w in enumerate(copy)]
        docs.append((k, " ".join(phrase(6) + copy + phrase(6))))
    for k in range(300, 420):
        item = items[k % 12]
        copy = [word(rng) if at % 7 == k % 7 else w for at, w in enumerate(item)] if k % 2 else []
        docs.append((k, " ".join(phrase(10) + copy + phrase(10))))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(*tables).collect()}
    assert got == plain(docs, bench) and len(got) > 300
    # The frequent phrases are no seeds of items with rarer runs around them: those that are copied,
    # but for the one that is about as frequent.
    runs = decontam._item_runs(tables[1].selectExpr("item_id", "item_id AS item", "text"), 3)
    seen = decontam._frequencies(tables[0].selectExpr("doc_id", "doc_id AS text_key", "text"), spark.sparkContext.broadcast(decontam._bitmap(runs)), [3])
    kept = decontam._seeds(runs, seen, 3).join(seen, "run").filter("n_docs > 350")
    assert not {r.item for r in kept.collect()} & {1, 3, 5, 7, 9, 11} and seen.filter("n_docs > 350").count() > 0


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    bench = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i}") for i in range(20)]
    docs = [(i, f"before it {t} after it") for i, t in bench if i % 2]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontam, "MOST_RUNS", 50)
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontam.contaminated(*tables).collect()) == [(i, i, 1.0) for i, _ in docs]


def test_items_of_one_and_two_words(spark):
    docs = [(1, "say Open Sesame now"), (2, "open the sesame"), (3, "xyzzy"), (4, "a b xyzzy, open"), (5, None)]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "open sesame"), (2, "xyzzy"), (3, "!"), (4, "of three words")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word) for r in found.collect()) == [(1, 1, 1.0, 1), (3, 2, 1.0, 0), (4, 2, 1.0, 2)]


def test_a_passage_of_more_than_a_million_words():
    rng = np.random.default_rng(8)
    passage, item = rng.integers(100, 1 << 31, 1_200_000).astype(np.uint32), np.arange(40, dtype=np.uint32)
    passage[1_150_000:1_150_040] = item
    assert decontam.align(item, passage) == (80, 1_150_000, 1_150_040)


def test_part_of_a_passage_that_is_aligned():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(3, 20))
        item, passage = rng.integers(0, 12, n).astype(np.uint32), rng.integers(0, 12, int(rng.integers(3, 120))).astype(np.uint32)
        at = int(rng.integers(0, len(passage)))
        passage[at : at + n] = item[: len(passage) - at]
        need = decontam._needed(n, 0.5)
        want = decontam.align(item, passage)
        a, b = decontam._within(item, passage, need)
        if want[0] >= need:
            got = decontam.align(item, passage[a:b])
            assert (got[0], got[1] + a, got[2] + a) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.contaminated(docs, bench).count() == 1


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, 7), rng.integers(0, 4, 15)
        h = np.zeros((8, 16), int)
        for i, j in itertools.product(range(1, 8), range(1, 16)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, first, end = decontam.align(a.astype(np.uint32), b.astype(np.uint32))
        assert score == h.max()
        if score:
            assert decontam.align(a.astype(np.uint32), b[first:end].astype(np.uint32))[0] == score
