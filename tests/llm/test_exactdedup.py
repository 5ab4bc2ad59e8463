import hashlib
import random

from tracefold.llm.exactdedup import CuckooIndex, exact_dedup


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(5)
    index, truth = CuckooIndex(buckets=2), {}
    for step in range(20_000):
        key = hashlib.sha256(str(rng.randrange(6000)).encode()).digest()
        if key in truth and rng.random() < 0.5:
            assert index.delete(key)
            del truth[key]
        elif key not in truth:
            assert key not in index
            index.insert(key, step)
            truth[key] = step
    assert dict(index.items()) == truth and len(index) == len(truth)
    assert not index.delete(b"\0" * 32)


def test_equal_fingerprints_do_not_join_different_keys():
    index = CuckooIndex(buckets=2)
    one, two = b"\x01" * 10 + b"a" * 22, b"\x01" * 10 + b"b" * 22
    index.insert(one, 1)
    assert two not in index
    index.insert(two, 2)
    assert (index.get(one), index.get(two)) == (1, 2)


ROWS = [(1, "a b"), (2, "ab"), (3, " a  b"), (4, None), (5, "  \t"), (6, "x"), (6, "x"), (None, "a\nb  "), (None, "q"), (7, "é"), (8, "y" * 100_000)]


def test_groups(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, keep_id int")
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(exact_dedup(docs).collect()) == len(ROWS)
    for i in (1, 2, 3, None):
        r = got[i, sha("ab")]
        assert (r.keep_id, r.group_size, r.kept) == (3, 4, i == 3)
    assert (got[4, sha("")].keep_id, got[5, sha("")].keep_id, got[5, sha("")].group_size) == (5, 5, 2)
    assert (got[6, sha("x")].keep_id, got[6, sha("x")].group_size, got[6, sha("x")].kept) == (6, 2, True)
    assert (got[None, sha("q")].keep_id, got[None, sha("q")].kept) == (None, True)
    assert got[8, sha("y" * 100_000)].kept and got[7, sha("é")].kept


def test_most_code_points_then_smallest_id(spark):
    docs = spark.createDataFrame([(3, "ab"), (2, "a b"), (1, "a b"), (9, "a  b "), (4, "a  b ")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup(docs).collect()} == {4}


def test_deleted_rows_are_not_live(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "a b")], "doc_id long, text string")
    gone = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(docs, gone).collect()] == [(1, 1, 1)]


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
