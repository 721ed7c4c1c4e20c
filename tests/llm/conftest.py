import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, ties, odd characters."""
    rows = [
        (0, "The quick brown fox jumps over the lazy dog.", "en", "a", 44), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "b", 6),
        (4, "The quick brown fox jumps over the lazy dog.", "en", None, 44), (5, "the QUICK brown fox jumps over the lazy dog.", None, "b", 44),
        (6, "über straße ñandú \x00 \U0001f600 日本語", "de", "c", 20), (7, "x" * 50_000, "en", "c", 50_000), (8, "word " * 20_000, "en", "c", 100_000),
        (9, "one two", "en", "a", 7), (9, "one two", "en", "a", 7), (10, "12345 !!! ???", "fr", "a", 13), (None, "no id here", "en", "a", 10),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def crowded(odd):
    """The same with extra columns whose names clash with operators' own."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("score", "predicted", "held_out", "label", "key", "cls", "n", "size", "shard", "rank", "a", "b", "query_id", "weight", "place", "ids", "component_id"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
