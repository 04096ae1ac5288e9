import random

import pytest
from pyspark.sql import types as T

from linkgraph.llm import tokenizer as K

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return K.BytePairEncoder(K.load_ranks())


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=K.PRE_TOKEN, mergeable_ranks=K.load_ranks(), special_tokens={})


def test_perfect_hash():
    keys = {f"k{i}".encode(): i for i in range(3000)} | {b"": 7}
    h = K.PerfectHash(keys)
    assert all(h.get(k) == v for k, v in keys.items()) and sorted(h.keys) == sorted(keys)
    assert all(h.get(f"x{i}".encode()) == -1 for i in range(2000))
    assert K.PerfectHash({b"a": 1}).get(b"a") == 1


def test_random_texts(encoder, known):
    r = random.Random(2)
    pool = "aábc 1٢\n\t\x0b\x1c\x85 　'’sS。é漢🙂<|endoftext|>"
    for _ in range(3000):
        s = "".join(r.choice(pool) for _ in range(r.randrange(40)))
        assert encoder.encode(s) == known.encode_ordinary(s)


def test_every_kind_of_character(encoder, known):
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            s = f"a {chr(c)} {chr(c)}b{chr(c)}{chr(c)}"
            assert encoder.encode(s) == known.encode_ordinary(s)


def test_very_long_word(encoder, known):
    s = "abc" * 30_000
    assert encoder.encode(s) == known.encode_ordinary(s)


def test_columns(spark, known):
    texts = ["Hello world", "", None, "  x\n\n", "é" * 500, "Hello world"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.IntegerType())])
    df = spark.createDataFrame([(i if i != 3 else None, t, 5) for i, t in enumerate(texts)], schema)
    got = {r["doc_id"]: r["ids"] for r in K.encode_column(df, "doc_id", "text").collect()}
    assert got == {i if i != 3 else None: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in K.count_column(df, "text", ["doc_id", "ids"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert K.encode_column(df.where("false"), "doc_id", "text").count() == 0
    assert K.encode_column(df, "doc_id", "text").schema["ids"].dataType == T.ArrayType(T.IntegerType())
