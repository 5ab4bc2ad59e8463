import random

import numpy as np

from tracefold.llm import langid

WORDS = {"aa": ["shala", "minor", "katel", "ounis"], "bb": ["grumpf", "zwolk", "brutz", "knarz"], "cc": ["привет", "слово", "место", "город"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def model(spark):
    rng = random.Random(1)
    docs = [(lang, text(rng, lang, 40)) for lang in WORDS for _ in range(5)] + [(None, "x"), ("aa", None)]
    return langid.train(spark.createDataFrame(docs, "lang string, text string"))


def test_spans_of_mixed_text(spark):
    rng = random.Random(2)
    m = model(spark)
    assert m.languages == ["aa", "bb", "cc"]
    mixed = " ".join([text(rng, "aa", 30), text(rng, "bb", 20), text(rng, "cc", 10)])
    data = [(1, mixed, 0), (2, text(rng, "bb", 9), 0), (3, None, 0), (4, "", 0), (5, "12 !! 34", 0), (None, text(rng, "cc", 3), 0), (6, text(rng, "aa", 30_000), 0), (6, "漢字", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    got = [tuple(r) for r in langid.identify(docs, m).collect()]
    first = next(r for r in got if r[0] == 1)
    assert [(s.first_word, s.after_word, s.lang) for s in first[3]] == [(0, 30, "aa"), (30, 50, "bb"), (50, 60, "cc")]
    rest = sorted((r[0] or 0, r[1], r[2]) for r in got if r[0] != 1)
    assert rest == [(0, "cc", 1.0), (2, "bb", 1.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (6, "aa", 1.0), (6, "aa", 1.0)]
    kept = langid.identify(docs, m, keep=True)
    assert kept.columns == ["doc_id", "text", "score", "__found"]


def test_texts_without_a_letter_are_unknown(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["×××", "÷", "١٢٣", "٪", "  \n", "½ ² €", "ª", "12 é"])], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model(spark)).collect()}
    assert all(found[k] == ("und", 0.0) for k in range(6)) and all(found[k][0] != "und" for k in (6, 7))


def test_three_hundred_languages_and_clashing_names(spark):
    rng = random.Random(4)
    names = [f"l{k:03d}" for k in range(300)]
    own = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(6)] for n in names}
    docs = [(n, " ".join(own[n] * 3)) for n in names]
    m = langid.train(spark.createDataFrame(docs, "lang string, text string"))
    assert m.languages == names
    data = spark.createDataFrame([(k, " ".join(own[n]), "x") for k, n in enumerate(names)], "doc_id long, text string, __found string")
    found = langid.identify(data, m, keep=True)
    assert found.columns == ["doc_id", "text", "__found", "___found"]
    assert [r[0] for r in found.orderBy("doc_id").select("___found.lang_pred").collect()] == names


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 5, 6, 14])
    scores = rng.normal(size=(14, 3)).astype(np.float32) * 3
    got = langid.viterbi(scores, first, 2.0)

    def value(path, s):
        return sum(s[t, x] for t, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max((value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(best - value(list(got[a:b]), scores[a:b])) < 1e-3


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    m = model(spark)
    rng = random.Random(4)
    data = [(k, text(rng, rng.choice("abc") * 2, rng.randrange(1, 30))) for k in range(60)]
    together = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), m).collect()}
    alone = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string").repartition(4, "doc_id"), m).collect()}
    assert together == alone


def test_nothing_learned_and_empty_table(spark):
    none = langid.train(spark.createDataFrame([], "lang string, text string"))
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert [tuple(r)[1:3] for r in langid.identify(docs, none).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), none).count() == 0
