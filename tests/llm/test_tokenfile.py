import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracefold.llm import tokenfile


@pytest.mark.parametrize("bits", range(1, 33))
def test_packed_ids_come_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = tokenfile.pack_bits(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8
        back = tokenfile.unpack_bits(data, bits)
        assert (back[:n] == ids).all() and not back[n:].any()


@pytest.mark.parametrize("bits", [3, 16, 17])
def test_random_access_reads_any_range(bits):
    rng = np.random.default_rng(1)
    docs = [(int(i) if i % 7 else None, rng.integers(0, 1 << bits, rng.integers(0, 900)).astype(np.uint32)) for i in range(40)]
    sink = io.BytesIO()
    sink.close, data = lambda: None, None
    out = tokenfile.TokenFileWriter(sink, bits, block=128)
    for doc_id, ids in docs:
        out.add(doc_id, ids)
    out.close()
    data = sink.getvalue()
    f = tokenfile.TokenFile(pa.BufferReader(data))
    all_ids = np.concatenate([ids for _, ids in docs])
    assert f.n_ids == len(all_ids) and len(data) < len(all_ids) * bits / 8 * 1.2 + 3000
    for low, high in [(0, 0), (0, 1), (127, 129), (128, 256), (5, len(all_ids)), *rng.integers(0, len(all_ids), (50, 2))]:
        assert (f.ids(low, max(low, high)) == all_ids[low : max(low, high)]).all()
    for most in (1, 500, 1 << 20):
        got = list(f.documents(most))
        assert [x[0] for x in got] == [x[0] for x in docs] and all((a[2] == b[1]).all() for a, b in zip(got, docs, strict=True))
    with pytest.raises(ValueError):
        tokenfile.TokenFileWriter(io.BytesIO(), bits).add(1, np.array([1 << bits], np.uint32))
    with pytest.raises(ValueError):
        tokenfile.TokenFile(pa.BufferReader(b"x" * 200))


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) in order of the ids."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_the_tokenizer(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, tokenfile.op12_token_files(spark, f"/root/testdata/{sf}").collect())) == plain(map(tuple, rows))


def test_edges_of_the_table(spark, tmp_path):
    rows = [(5, None, "a"), (-3, "", "b"), (2, "two  words\n\n", "c"), (9, "<|endoftext|> \U0001f600 \x1c", "d"), (7, "long " * 40_000, "e"), (None, "no id", "f"), (4, "x" * 5000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = f"file://{tmp_path}/many"
    tokenfile.write_tokens(docs, path, file_ids=100)
    got = tokenfile.token_digests(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == plain([r[:2] for r in rows])
    whole = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}
    assert zlib.crc32(whole[2].ids) == plain([rows[2][:2]])[0][3]
    files = tokenfile.token_files(spark, path).orderBy("start").collect()
    assert len(files) >= 2 and sum(f.n_docs for f in files) == len(rows)


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, "same"), (1, "same"), (1, "other words here"), (0, "zero")] * 5
    path = f"file://{tmp_path}/again"
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = sorted(map(tuple, tokenfile.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in plain(rows))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    path = f"file://{tmp_path}/none"
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokenfile.token_digests(spark, path).count() == tokenfile.token_files(spark, path).count() == 0
