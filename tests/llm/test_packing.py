import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracefold.llm import packing

TEXTS = ["", None, "one two  three\n\n four", "a \n b\t\tc   d", "naïve — “quotes” 漢字 \U0001f600 it's 3.14", "   lead and trail \x1c\n", "word " * 3000, "<|endoftext|> is one id", "a<|endoftext|>b  <|endoftext|>", "x" * 5000, "same", "same"]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_agrees_with_the_vocabulary_file(ids):
    encode = packing.TextEncoder(packing.default_vocabulary())
    for text in TEXTS:
        assert encode(text or "") == ids(text)[:-1].tobytes()


def test_pieces_hold_each_id_once(spark, ids):
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    out = packing.with_digest(packing.pack(docs.coalesce(1))).toPandas()
    assert list(out.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for i, text, _ in rows:
        own = out[out.doc_id.isna()] if i is None else out[out.doc_id == i]
        own = own.sort_values("start")
        want = ids(text)
        assert (own.doc_tokens == len(want)).all() and own.length.sum() == len(want)
        assert (own.start == own.length.cumsum() - own.length).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes())
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and all(n & (n - 1) == 0 for n in sizes)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 3000)
    pieces = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    cost = np.array([sum(n + n * n / 2048 for _, _, n in p) for p in pieces if sum(n for _, _, n in p) == 2048])
    worst = np.array([sum(lengths[a] + lengths[a] ** 2 / 2048 for a in range(k, k + 2)) for k in range(0, 2998, 2)])
    assert cost.std() < worst.std() / 3
    got = np.zeros(len(lengths), int)
    for p in pieces:
        for i, _, n in p:
            got[i] += n
    assert (got == lengths).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0


def test_capacity_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), capacity=1000)
