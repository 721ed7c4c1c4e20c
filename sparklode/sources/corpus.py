"""Readers and writers of corpora, test cases, model files, indexes and reports.

A corpus file is one JSON object, id -> {comments, snippets, key}; the order of
its ids is the documents' order (``ord``): ids that are whole numbers (below 2^32 - 1,
without leading zeros) come first by value, then the others as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("comments", T.ArrayType(T.StringType())),
        T.StructField("snippets", T.ArrayType(T.StringType())),
        T.StructField("key", T.StringType()),
    ]
)
CASE = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "query", "lang")])
INDEXED = T.StructType([T.StructField("id", T.StringType()), T.StructField("doc", DOCUMENT), T.StructField("embeddings", T.ArrayType(T.ArrayType(T.DoubleType())))])
MODEL_INFO = T.StructType([T.StructField("vocabulary", T.MapType(T.StringType(), T.IntegerType())), T.StructField("keys", T.ArrayType(T.StringType()))])


def _whole(spark: SparkSession, path: str, schema: T.DataType) -> DataFrame:
    """One JSON value per file, read under a given schema; malformed files fail."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))


def read_corpus(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """(lang, ord, id, comments, snippets, key) of a corpus file, in file order."""
    whole = _whole(spark, path, T.MapType(T.StringType(), DOCUMENT)).select(F.map_entries("value").alias("es"))
    number = lambda e: e["key"].rlike("^(0|[1-9][0-9]{0,9})$") & (e["key"].try_cast("long") < 4294967295)
    first = F.array_sort(F.filter("es", number), lambda a, b: (a["key"].cast("long") - b["key"].cast("long")).cast("int"))
    entries = whole.select(F.posexplode(F.concat(first, F.filter("es", lambda e: ~number(e)))).alias("ord", "e"))
    return entries.select(F.lit(lang).cast("string").alias("lang"), F.col("ord").cast("long").alias("ord"), F.col("e.key").alias("id"), "e.value.comments", "e.value.snippets", F.col("e.value.key").alias("key"))


def read_corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The corpora of several languages as one table with a ``lang`` column."""
    parts = [read_corpus(spark, path, lang) for lang, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(no, key, query, lang) test cases of a JSON array; a file that can't be read fails."""
    return _whole(spark, path, T.ArrayType(CASE)).select(F.posexplode("value").alias("no", "case")).select("no", "case.*")


def read_model_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (term, idx) and the keys (idx, key) of a TF-IDF model file."""
    info = _whole(spark, path, MODEL_INFO)
    return info.select(F.explode("value.vocabulary").alias("term", "idx")), info.select(F.posexplode("value.keys").alias("idx", "key"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_path, line_no from 0, line) of text files."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_path"), "value")
    return text.select("doc_path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def line_before(lines: DataFrame) -> DataFrame:
    """Adds ``before``, the line above; the first line of a file has none and drops out."""
    above = F.lag("line").over(Window.partitionBy("doc_path").orderBy("line_no"))
    return lines.withColumn("before", above).where(F.col("line_no") > 0)


def has_snippets(snippets: Column) -> Column:
    """Lexical search holds only documents that have something to insert."""
    return F.coalesce(F.size(snippets), F.lit(0)) > 0


def save_index(index: DataFrame, path: str) -> None:
    """The dense index as Parquet, one folder per language."""
    writer = index.write.mode("overwrite")
    (writer.partitionBy("lang") if "lang" in index.columns else writer).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved index; vectors are single precision."""
    return spark.read.parquet(path).withColumn("embeddings", F.col("embeddings").cast("array<array<float>>"))


def export_index(index: DataFrame, path: str) -> None:
    """The index as JSON rows {id, doc, embeddings} for other programs."""
    index.select("id", "doc", F.col("embeddings").cast("array<array<double>>").alias("embeddings")).write.mode("overwrite").json(path)


def import_index(spark: SparkSession, path: str) -> DataFrame:
    """An exported index, or one JSON array file of the same entries."""
    return spark.read.schema(INDEXED).option("multiLine", "true").json(path).withColumn("embeddings", F.col("embeddings").cast("array<array<float>>"))


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (column ``line``, ordered by ``no``) as one text file."""
    lines.coalesce(1).sortWithinPartitions("no").select("line").write.mode("overwrite").text(path)
