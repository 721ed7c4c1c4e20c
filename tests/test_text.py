"""Text functions, language routing, chunks and vectors on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.functions import lang, porter, text, vector
from sparklode.operators import dense


def one(spark, value, make, name="x string"):
    return spark.createDataFrame([(value,)], name).select(make(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [("Née arc", ["ne", "e", "arc"]), ("Draw a BOX, box!", ["draw", "a", "box", "box"]), ("", []), (None, []), ("ﬁne ①", ["fine", "1"]), ("—", [])],
)
def test_lexical_tokens(spark, given, tokens):
    assert one(spark, given, text.lexical_tokens) == tokens


def test_query_terms_keep_underscores_and_drop_stop_words(spark):
    assert one(spark, "How to draw a Foo_bar box?", lambda c: text.query_terms(c, stemming=False)) == ["draw", "foo_bar", "box"]
    assert one(spark, "drawing boxes", lambda c: text.query_terms(c, stop_words=("boxes",))) == ["draw"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("is", "is"),
    ],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


@pytest.mark.parametrize(
    ("given", "lang_"),
    [
        ("draws a rectangle", "en"), ("分层标签", "zh-cn"), ("繪製並維護工具列", "zh-tw"), ("工具列物件", "zh-cn"), ("UTF-8文字", "en"), ("UTF-8标签", "zh-cn"),
        ("Box繪製", "zh-tw"), ("123 !?", "Undetermined"), ("", "Undetermined"), (None, "Undetermined"), ("éàü", "Undetermined"),
    ],
)
def test_identify_language(spark, given, lang_):
    assert one(spark, given, lang.identify_language) == lang_
    assert one(spark, given, lang.route) == ("en" if lang_ == "Undetermined" else lang_)


@pytest.mark.parametrize(
    ("line", "query"),
    [("    { draws a rectangle }", "draws a rectangle"), ("{a}{b}", "a}{b"), ("{   }", None), ("x { a }", None), ("　{ 文字 }　", "文字"), (None, None)],
)
def test_brace_query(spark, line, query):
    assert one(spark, line, text.brace_query) == query


def test_retrieval_text_keeps_the_place_of_null_lines(spark):
    assert one(spark, ["a", None, "b"], text.retrieval_text, "x array<string>") == "a  b"


@pytest.mark.parametrize(("n", "starts", "last"), [(0, [], None), (1, [0], 1), (512, [0], 512), (513, [0, 462], 51), (974, [0, 462], 512), (975, [0, 462, 924], 51)])
def test_chunk_windows(spark, n, starts, last):
    assert one(spark, n, vector.chunk_starts, "x int") == starts
    chunks = dense.cut_chunks(list(range(n)))
    assert [c[0] for c in chunks] == starts
    assert (len(chunks[-1]) if chunks else None) == last


def test_padding(spark):
    assert one(spark, [5, 6], lambda c: vector.padded(c, 4), "x array<int>") == [5, 6, 0, 0]
    assert one(spark, [5, 6, 7], lambda c: vector.padded(c, 2), "x array<int>") == [5, 6]
    assert one(spark, [5, 6], lambda c: vector.attention_mask(c, 4), "x array<int>") == [1, 1, 0, 0]


def test_vectors(spark):
    unit = one(spark, [3.0, 4.0], vector.l2_normalize, "x array<float>")
    assert unit == pytest.approx([0.6, 0.8])
    assert all(math.isnan(x) for x in one(spark, [0.0, 0.0], vector.l2_normalize, "x array<float>"))
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>")
    assert pooled.select(vector.mean_pool(F.col("v"), F.col("m"), 2).alias("y")).collect()[0]["y"] == [2.0, 3.0]


def test_pooling_ignores_padding():
    hidden = np.array([[[1.0, 0.0], [1.0, 2.0], [50.0, 50.0]]])
    assert dense.pool(hidden, np.array([[1, 1, 0]]))[0] == pytest.approx(np.array([1, 1]) / math.sqrt(2))
