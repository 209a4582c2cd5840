import os
import random

import pytest
from pyspark.sql import types as T

from treadle.llm import packing, tokenizing
from treadle.session import table

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizing.VOCABULARY), reason="no vocabulary")

TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\n\n  indent\n", "don't we'll I'M", "naïve café 東京 12３４ ½", "\x1c x\x1d y", " nb　wide",
    "<|endoftext|> is text", "é combining \U0001f600\U0001f3fd!", "x" * 5000, "a b " * 2000, "\r\n\r\n  ", "a b \u0085 c", "same", "same",
]


def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: None if x is None else t.encode(x, add_special_tokens=False).ids


def test_ids_match_the_library(spark, monkeypatch):
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab C1.\n\t é東 '_-") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + noise)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    ref = reference()
    assert {r.doc_id: r.ids for r in tokenizing.encode_corpus(df).collect()} == {i: ref(t) for i, t, _ in rows}
    assert {r.doc_id: r.n for r in tokenizing.token_counts(df).collect()} == {i: None if t is None else len(ref(t)) for i, t, _ in rows}


def test_blocks_do_not_matter(spark):
    import pyarrow as pa

    rows = [(f"k{i}", t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "k string, body string").coalesce(1)
    ref = reference()
    old = tokenizing.BLOCK_CHARS
    tokenizing.BLOCK_CHARS = 50
    try:
        got = {r.k: r.ids for r in tokenizing.encode_corpus(df, "k", "body").collect()}
    finally:
        tokenizing.BLOCK_CHARS = old
    assert got == {k: ref(t) for k, t in rows}
    assert pa is not None


def test_empty_table_and_all_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenizing.encode_corpus(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.ids) for r in tokenizing.encode_corpus(nulls).collect()) == [(0, None), (1, None), (2, [])]


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = tokenizing.decode_corpus(tokenizing.encode_corpus(df), tokenizing.token_bytes(spark), run=16)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)


def test_first_fit_against_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 64, 300):
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        rooms: list[int] = []
        want = []
        for s in sizes:
            i = next((i for i, r in enumerate(rooms) if r >= s), len(rooms))
            if i == len(rooms):
                rooms.append(100)
            rooms[i] -= s
            want.append(i)
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_every_token_once(spark):
    rows = [(1, 5000), (2, 2048), (3, 1), (4, 0), (5, None), (6, 2049), (6, 700)] + [(10 + i, 37 * i % 1500) for i in range(400)]
    out = packing.pack(spark.createDataFrame(rows, T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])), "k", "n").collect()
    fill: dict = {}
    for r in out:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
        assert 0 < r.n_tokens <= packing.CAPACITY
    assert max(fill.values()) <= packing.CAPACITY
    assert sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert [(r.token_start, r.n_tokens) for r in sorted(out, key=lambda r: r.piece) if r.k == 1] == [(0, 2048), (2048, 2048), (4096, 904)]
    assert all(r.piece == 0 for r in out if 10 <= r.k)
    assert packing.pack(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0
    assert table is not None
