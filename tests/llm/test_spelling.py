import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tracefold.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def neighbours(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    near = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return near - {word}


def plain(rows):
    """word -> (form, root, n, n_near, form_n), by writing out all neighbours of each word."""
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = {c for w in n for c in w}
    near = {w: [v for v in neighbours(w, letters) if v in n] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def as_dict(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = as_dict(spelling.op13_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert got == plain(map(tuple, rows)) and sum(v[0] is not None for v in got.values()) > 100


def near(a, b):
    return a != b and b in neighbours(a, set(a + b))


def test_pairs_are_all_pairs_one_edit_apart(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abà") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    expected = sorted((a, b) for a in words for b in words if (len(a), a) < (len(b), b) and near(a, b))
    for depth in (1, 2, 3):
        assert sorted((r.a, r.b) for r in spelling.near_pairs(table, depth).collect()) == expected


def test_chains_of_forms_lead_to_their_root(spark):
    chain = ["aaaaa" + "b" * k for k in range(12)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 << (11 - k)))
    got = as_dict(spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got == {w: (chain[k - 1] if k else None, "aaaaa", 3 << (11 - k), (k > 0) + (k < 11), 3 << (12 - k) if k else None) for k, w in enumerate(chain)}


def test_edges_of_the_table(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "1234 !? 中文", 1), (None, "Colour colour COLOUR color color colors", 2), (5, "color color color color color color’s", 3), (5, "colour", 4)]
    rows += [(6, "z" * 3000 + " " + "z" * 2999 + " Étude étude étude", 1)] * 3 + [(7, "three three three threw threw threw threé threé threé", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = as_dict(spelling.spelling_variants(docs, count=spelling.misspelt))
    assert got == plain([r[:2] for r in rows])
    assert got["color"][2] == 8 and got["colour"][0] == "color" and got["three"][0] is None and got["three"][3] == 2
    tie = spark.createDataFrame([(1, "aback aback aback " + "abeck " * 6 + "abuck " * 6)], "doc_id long, text string")
    assert as_dict(spelling.spelling_variants(tie))["aback"] == ("abeck", "abeck", 3, 2, 6)
    assert spelling.spelling_variants(docs.filter(F.lit(False))).count() == 0
    assert as_dict(spelling.spelling_variants(docs, count=spelling.misspelt)) == got


def test_counts_flush_in_parts(spark):
    rows = [(i, f"word{chr(97 + i % 26) * 2} common common") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(spelling.word_counts(docs, held=3).collect()) == sorted(spelling.word_counts(docs).collect())


def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = {r[0]: tuple(r[1:]) for r in con.sql(spelling.OP13_SQL).fetchall()}
    assert got == plain(con.sql("SELECT doc_id, text FROM documents").fetchall())
