import random

import corpus_pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(3, 9)))
    prose = lambda n=120: " ".join(word() for _ in range(n))
    clean = [(k, prose() + "\n" + prose()) for k in range(40)]
    copy = prose(200)
    items = [(k, prose(30)) for k in range(5)]
    rows = clean + [(100 + k, f"{copy} end{'x' * k}") for k in range(5)]
    rows += [(200 + k, f"{prose()}\n{items[k][1]}\n{prose()}") for k in range(5)]
    rows += [(300 + k, f"{prose()}\nSubscribe to our newsletter number {k} now") for k in range(6)]
    rows += [(400, None), (401, ""), (402, "123 456"), (None, prose())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    ids = {k for k, _ in clean}
    assert all(ids <= set(x) and None in x for x in seen.values())
    assert all(seen["benchmark"][k] == t for k, t in clean)
    assert not {400, 401, 402} & set(seen["language"])
    assert "Subscribe" in seen["lines"][300] and all("Subscribe" not in seen["lines"][300 + k] for k in range(1, 6))
    assert {100 + k for k in range(5)} & set(seen["near_copies"]) == {100}
    assert not {200 + k for k in range(5)} & set(seen["benchmark"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["benchmark"])


def test_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    text = "some words of a page that are repeated here and there"
    rows = [(1, text), (1, text), (2, None), (None, None), (3, ""), (None, text), (4, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "e", "f", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, line string, __gone string, __id long")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, own in enumerate((docs, docs.limit(0))):
        now = own
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
            now.write.parquet(str(tmp_path / f"{k}{name}"))
            now = spark.read.schema(docs.schema).parquet(str(tmp_path / f"{k}{name}"))
        assert corpus_pipeline.pack(spark, now, str(tmp_path)).count() == 0  # no language is known, so all go


def test_later_stages_keep_rows_with_nulls(spark, tmp_path):
    text = "some words of a page that are repeated here and there"
    rows = [(1, text), (1, text), (2, text), (3, None), (None, None), (None, text)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([(1, text), (1, text), (3, ""), (0, ""), (0, text)])
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == len(rows)
    assert {r.n_chars for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).filter("text IS NULL").collect()} == {None}


def test_benchmark_stage_takes_rows_by_id_and_text(spark, tmp_path):
    item = "these are the words of an item of the benchmark that was copied here"
    rows = [(None, item), (None, "clean words"), (1, item), (1, "clean words"), (2, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, text_key string, id long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, "clean words"), (1, "clean words"), (2, "")]
    assert corpus_pipeline.near_copies(spark, docs, str(tmp_path)).count() == len(rows)
