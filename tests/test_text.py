import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.functions.routing import jump_buckets, shard_of
from tamiz.functions.stemmers import english, portuguese, spanish


def tokens(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(text.tokenize(F.col("t"))).first()[0]


def test_tokenizer(spark):
    assert tokens(spark, "hello, world! How's it going?") == ["hello", "world", "How's", "it", "going"]
    assert set(tokens(spark, "Samsung Galaxy S24 256GB $799.99")) >= {"Samsung", "Galaxy", "S24", "256GB"}
    assert tokens(spark, "!!! --- ???") == [] and tokens(spark, "") == [] and tokens(spark, None) == []


def test_driver_and_plan_split_alike(spark):
    for s in ("TELÉFONO móvil 1.5L", "a.b.c d'e 3,4 _x_ ñandú", "x" * 10_000):
        assert tokens(spark, s) == text.tokenize_python(s)


def test_offsets(spark):
    out = spark.createDataFrame([("año, ok",), (None,)], "t string").select(text.token_offsets(F.col("t")).alias("o")).collect()
    assert [tuple(x) for x in out[0].o] == [("año", 0, 4, 0), ("ok", 6, 8, 1)] and out[1].o == []


def test_keyword_and_fold(spark):
    df = spark.createDataFrame([("A > B",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.keyword_tokens(F.col("t"))).collect()] == [["A > B"], [], []]
    assert spark.createDataFrame([("CÁLIDA Ñandú",)], "t string").select(text.fold(F.col("t"))).first()[0] == "calida nandu"
    assert len(text.ACCENTED) == len(text.PLAIN)


@pytest.mark.parametrize("a,b,stem", [("shoes", "shoe", english), ("running", "runs", english), ("batteries", "battery", english), ("zapatos", "zapato", spanish), ("computadoras", "computadora", spanish), ("corriendo", "correr", spanish), ("sapatos", "sapato", portuguese), ("computadores", "computador", portuguese), ("correndo", "correr", portuguese)])
def test_stems_agree(a, b, stem):
    assert stem(a) == stem(b)


def test_known_stems():
    assert [english(w) for w in ("galaxy", "caresses", "national", "hopping", "hoped")] == ["galaxi", "caress", "nation", "hop", "hope"]
    assert [spanish(w) for w in ("chicharrones", "rápidamente", "torneados")] == ["chicharron", "rapid", "torn"]
    assert portuguese("quilométricas") == "quilométr"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeéiíoórstuyñçã'", max_size=14))
def test_stemmers_never_fail(w):
    for f in (english, spanish, portuguese):
        assert len(f(w)) <= len(w) + 2


def test_jump_hash(spark):
    import numpy as np

    keys = np.array([0, 1, 2, 3, 42, 999, 10000], dtype=np.uint64)
    assert jump_buckets(keys, 4).tolist() == [0, 0, 3, 3, 2, 0, 2]
    assert jump_buckets(keys, 2).tolist() == [0, 0, 0, 0, 1, 0, 1]
    counts = np.bincount(jump_buckets(np.arange(100_000, dtype=np.uint64), 8))
    assert counts.min() > 0.95 * 12_500 and counts.max() < 1.05 * 12_500
    assert [r[0] for r in spark.createDataFrame([(1,), (None,)], "id long").select(shard_of(F.col("id"), 4)).collect()] == [0, None]
