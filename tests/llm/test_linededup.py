import duckdb

from tracefold.llm import linededup

LINES = ["Posted on 12 by Ann Lee in our news", "Posted on 7 by Bob Ray in our news"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_templates_generalise_and_first_document_keeps_them(spark):
    docs = spark.createDataFrame([(k, f"own line {'abcde'[k - 1]} is here\n{LINES[(k - 1) % 2]}\n\nother {k}?", "p") for k in range(1, 6)], "doc_id long, text string, line string")
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    assert got[1].n_dropped == 0 and LINES[0] in got[1].text
    for k in range(2, 6):
        assert (got[k].n_lines, got[k].n_dropped) == (4, 2)
        assert got[k].text == f"own line {'abcde'[k - 1]} is here\n"


def test_nulls_repeats_clashing_names_and_long_texts(spark):
    long = "\n".join(f"{'x' * (k + 1)} own" for k in range(3000))
    data = [(1, "same line", "a"), (2, "same line", "b"), (2, "same line", "b"), (None, "same line", "c"), (3, None, None), (4, "", "d"), (5, " \n ", "e"), (6, long, "f")]
    docs = spark.createDataFrame(data, "doc_id long, text string, gone string")
    got = rows(linededup.line_dedup(docs))
    assert got == sorted([(1, "same line", 1, 0), (2, "", 1, 1), (2, "", 1, 1), (None, "", 1, 1), (3, None, 0, 0), (4, "", 1, 0), (5, " \n ", 2, 0), (6, long, 3000, 0)], key=str)
    kept = linededup.line_dedup(docs, keep=True)
    assert kept.columns == ["doc_id", "text", "gone", "__n_dropped"]
    assert linededup.line_dedup(docs.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, "same line", 7, 8, 9) for k in range(4)], "doc_id long, text string, __gone long, __id long, __n_dropped long")
    out = linededup.line_dedup(docs, keep=True)
    assert out.columns == [*docs.columns, "___n_dropped"]
    assert rows(out) == sorted([(0, "same line", 7, 8, 9, 0)] + [(k, "", 7, 8, 9, 1) for k in (1, 2, 3)], key=str)


def test_sentences_of_one_frame_are_no_template(spark):
    said = ["The committee said that wages rose in its report", "The committee said no such thing in its report", "The committee said prices had fallen in its report"]
    short = ["I love my dog", "I love my cat", "I love my car", "I love my new dog", "I love my old dog", "I love my red dog"]
    docs = spark.createDataFrame(list(enumerate(said + short)), "doc_id long, text string")
    assert {r.n_dropped for r in linededup.line_dedup(docs).collect()} == {0}


def test_lines_of_any_length_generalise(spark):
    """One word in a template differs; from 6 tokens on, and far above 12."""
    frames = {n: [f"w{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(n)] for n in (6, 7, 13, 20, 64, 300)}
    texts = []
    for k in range(4):
        lines = []
        for frame in frames.values():
            line = list(frame)
            line[len(line) // 2 + 1] = f"name{'abcd'[k]}"
            lines.append(" ".join(line))
        texts.append((k, "\n".join(lines)))
    got = {r.doc_id: r.n_dropped for r in linededup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 6, 2: 6, 3: 6}


def test_long_lines_need_two_documents(spark):
    long, short = " ".join(f"w{'abc'[k % 3]}" for k in range(60)), "a short line of two documents"
    docs = spark.createDataFrame([(1, f"{long}\n{short}"), (2, f"{short}\n{long}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.line_dedup(docs).collect()} == {1: f"{long}\n{short}", 2: short}


def test_two_documents_do_not_make_a_template(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.line_dedup(docs).collect()} == {0}


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = linededup.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_gives_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a {k} b c d e f g h\nLicensed under X {k}.0\nü {'z' * k}\nseen by {'pqrs'[k % 4]} in our daily news\n{'long line ' * 30}{'pq'[k % 2]}") for k in range(12)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(linededup.OP6_SQL).fetchall()
    got = linededup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped")
    assert rows(got) == sorted(want, key=str)


def test_what_counts_as_a_long_line_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five")], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.line_dedup(docs, long=6).collect()} == {0}
    assert {r.doc_id: r.n_dropped for r in linededup.line_dedup(docs, long=5).collect()} == {1: 0, 2: 1}


def test_many_dropped_lines_of_one_text(spark):
    # 60,000 lines, every second one dropped: lines times dropped lines would be 1.8e9 comparisons.
    word = lambda k: "".join(chr(97 + int(x)) for x in str(k))
    shared = [f"shared {word(k)}" for k in range(30000)]
    mixed = "\n".join(line for k, s in enumerate(shared) for line in (s, f"own {word(k)}"))
    docs = spark.createDataFrame([(1, "\n".join(shared)), (2, "\n".join(shared)), (3, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[3].n_dropped, got[3].n_lines) == (0, 30000, 30000, 60000)
    assert got[2].text == "" and got[3].text == "\n".join(f"own {word(k)}" for k in range(30000))
