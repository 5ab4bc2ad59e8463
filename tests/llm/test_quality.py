import random

from tracefold.llm import quality


def make(rng, k):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    good = k % 2
    return " ".join(words).capitalize() + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(w for w in words[:6] for _ in range(10))]), good


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(6)
    made = [make(rng, k) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)] + [(900, None), (901, ""), (None, "a"), (902, "word. " * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, (_, g) in enumerate(made) if k < 200] + [(5, None), (None, 1), (7, 0), (10_000, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    right = sum((score[k] >= 0.5) == bool(made[k][1]) for k in range(200, 300))
    assert right >= 97


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert [r.score for r in quality.classify(docs, model).collect()] == [0.5]
    assert quality.classify(docs.limit(0), model).count() == 0


def test_neighbours_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    terms = rng.random((80, quality._TERMS)).astype(np.float32)
    model = quality.Model(terms, rng.integers(0, 2, 80))
    v = model.project(terms)
    like = v @ model.vectors.T
    for i in range(5):
        near = np.argsort(-like[i])[: quality.NEIGHBOURS]
        w = np.maximum(like[i, near], 1e-6)
        assert abs(model.scores(terms[i : i + 1])[0] - (w * model.labels[near]).sum() / w.sum()) < 1e-4


def test_words_alone_tell_labels_apart(spark):
    """Both labels have words of one shape and length, so that only the words differ."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = [[word() for _ in range(60)] for _ in range(2)]
    text = lambda k: " ".join(rng.choice(own[k]) for _ in range(60))
    rows = [(k, text(k % 2)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    found = quality.classify(docs, quality.train(docs, labels)).filter("doc_id >= 200").collect()
    assert sum((r.score >= 0.5) == r.doc_id % 2 for r in found) >= 195


def test_the_bound_holds_for_repeated_ids(spark):
    rows = [(1, f"good words number {k}") for k in range(3000)] + [(2, "bad " * 20), (2, None), (3, "more good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, per_label=1)
    assert sorted(model.labels.tolist()) == [0, 1]
    again = quality.train(docs.repartition(5), labels, per_label=1)
    assert (model.vectors == again.vectors).all()
