"""The registered queries of the retrieval engine and their SQL, over the test tables.

Entities: documents are the corpus (ord = doc_id, comments = lines of text),
benchmark rows are queries, the first document that holds a benchmark text is
its expected answer, embeddings are chunk vectors (label = document), labels
name the known documents.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import lang, segment, text, vector
from ..operators import assemble, bm25, dense, evaluate, tfidf
from ..runtime import ship
from ..sources import corpus as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), "doc_id", "text", "lang", "source", F.split("text", "\n").alias("comments"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "item_id", "text")


# SQL fragments -------------------------------------------------------------

#: Decomposition of the tables' accented letters: base letter and a separator.
_FOLD = (("[éèê]", "e "), ("ó", "o "), ("ñ", "n "), ("ü", "u "), ("ç", "c "), ("ä", "a "), ("ö", "o "), ("í", "i "))


def sql_tokens(col: str) -> str:
    folded = f"lower({col})"
    for pattern, to in _FOLD:
        folded = f"regexp_replace({folded}, '{pattern}', '{to}', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({folded}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


def sql_terms(col: str) -> str:
    stops = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    plain = rf"lower(regexp_replace({col}, '[^A-Za-z0-9_\s]', ' ', 'g'))"
    return rf"list_filter(regexp_split_to_array({plain}, '\s+'), lambda x: x <> '' AND x NOT IN ({stops}))"


_DOCS = f"d AS MATERIALIZED (SELECT doc_id, {sql_tokens('text')} AS ws FROM documents), dl AS (SELECT doc_id, len(ws) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
_TF = "tok AS (SELECT doc_id, unnest(ws) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_BM25 = f"""{_DOCS}, {_TF},
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY item_id, doc_id)"""
_RANKED = f"""{_BM25},
every AS (SELECT b.item_id, dl.doc_id, coalesce(score, 0.0::DOUBLE) AS score FROM benchmark b CROSS JOIN dl LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = dl.doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM every QUALIFY rank <= 5)"""


# Projections and predicates ------------------------------------------------


@query("SELECT doc_id, replace(text, chr(10), ' ') AS joined FROM documents")
def corpus_text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.retrieval_text(F.col("comments")).alias("joined"))


def _brace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, no, before): every line of the benchmark texts in braces."""
    lines = items(spark, sf_dir).select("item_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select("item_id", "no", F.concat(F.lit("  { "), "line", F.lit(" }")).alias("before"))


@query(r"""SELECT item_id, no, query FROM (SELECT item_id, no, trim(regexp_extract('  { ' || line || ' }', '^(\s*)\{\s*(.*?)\s*\}\s*$', 2)) AS query
  FROM (SELECT item_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INTEGER AS no FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark))) WHERE query <> ''""")
def brace_query_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _brace_lines(spark, sf_dir).select("item_id", "no", text.brace_query(F.col("before")).alias("query"))
    return found.where(F.col("query").isNotNull())


@query(r"""SELECT page_id, line_no, length(regexp_extract(line, '^\s*', 0))::INTEGER AS indent FROM (
  SELECT page_id, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INTEGER AS line_no FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages))""")
def leading_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line_no", "line"))
    return lines.select("page_id", "line_no", F.length(text.leading_whitespace(F.col("line"))).alias("indent"))


@query("SELECT doc_id, nfc_normalize(text) AS clean FROM documents")
def nfc_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.nfc("text").alias("clean"))


# Language routing ----------------------------------------------------------

_HAN = "length(regexp_replace(text, '[^一-鿿]', '', 'g'))"
_LATIN = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(f"SELECT conv_id, turn, {_LATIN}::INTEGER AS latin, {_HAN}::INTEGER AS han, 0 AS simplified, 0 AS traditional FROM conversations")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lang.character_counts(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.cast("int").alias(k) for k, c in n.items()])


@query(f"SELECT conv_id, turn, CASE WHEN {_HAN} = 0 AND {_LATIN} > 0 THEN 'en' WHEN {_HAN} > 0 THEN 'zh-cn' ELSE 'Undetermined' END AS lang FROM conversations")
def language_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", lang.identify_language(F.col("text")).alias("lang"))


@query(f"SELECT CASE WHEN {_HAN} > 0 AND {_LATIN} = 0 THEN 'zh-cn' ELSE 'en' END AS lang, count(*) AS n FROM documents GROUP BY 1")
def language_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(lang.route(F.col("text")).alias("lang")).agg(F.count("*").alias("n"))


#: Texts of every script and answer, and of dictionary words.
HAN = (
    "draw a box", "画一个圆形的对话框", "繪製一個圓形對話方塊", "大小中文", "画 box 与圆", "繪 box 與圓", "中 box 文", "2026 !?", "", "カタカナ", "画繪", "ÀÉ ü 漢字汉字", "系统函数库中的对话框模块", "一", "函数",
)
WORDS = {"系统": 90.0, "函数": 80.0, "函数库": 60.0, "对话": 70.0, "对话框": 50.0, "模块": 40.0, "圆形": 30.0, "一个": 99.0, "中文": 45.0}
_HAN_ROWS = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(HAN)) + ") AS f(no, text)"
_SIMPLIFIED, _TRADITIONAL = (f"(length(text) - length(translate(text, '{table}', '')))" for table in lang.one_sided_characters())


def _han(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HAN)), "no int, text string")


@query(f"SELECT no, {_LATIN}::INTEGER AS latin, {_HAN}::INTEGER AS han, {_SIMPLIFIED}::INTEGER AS simplified, {_TRADITIONAL}::INTEGER AS traditional FROM {_HAN_ROWS}")
def han_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counters on texts in Han characters, which the tables lack."""
    return _han(spark).select("no", *[c.cast("int").alias(k) for k, c in lang.character_counts(F.col("text")).items()])


@query(f"""SELECT no, CASE WHEN h = 0 AND l > 0 THEN 'en' WHEN h = 0 THEN 'Undetermined' WHEN s > t THEN 'zh-cn' WHEN t > s THEN 'zh-tw' WHEN l > 0 THEN 'en' ELSE 'zh-cn' END AS lang
  FROM (SELECT no, {_LATIN} AS l, {_HAN} AS h, {_SIMPLIFIED} AS s, {_TRADITIONAL} AS t FROM {_HAN_ROWS})""")
def han_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _han(spark).select("no", lang.identify_language(F.col("text")).alias("lang"))


@query(f"""SELECT no, array_to_string(list_transform(range(1, greatest(length(text), 2)), lambda i: substr(text, i, 2)), ' ') AS tokens FROM {_HAN_ROWS}
  WHERE regexp_full_match(text, '[一-鿿]+')""")
def han_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter without a dictionary, on texts in Han characters alone."""
    rows = _han(spark).where(F.col("text").rlike(r"^[\x{4E00}-\x{9FFF}]+$"))
    return rows.select("no", F.array_join(segment.chinese_tokens()(F.col("text")), " ").alias("tokens"))


@query()
def han_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter with a dictionary."""
    return _han(spark).select("no", F.array_join(segment.chinese_tokens(WORDS)(F.col("text")), " ").alias("tokens"))


@query(f"""WITH w AS (SELECT no, unnest(list_transform(range(1, greatest(length(text), 2)), lambda i: substr(text, i, 2))) AS term FROM {_HAN_ROWS} WHERE regexp_full_match(text, '[一-鿿]+')),
dl AS (SELECT no, count(*) AS dl FROM w GROUP BY no), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT no, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT 1 AS query_id, no, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term) JOIN dl USING (no), st WHERE term IN ('对话', '话框') GROUP BY no""")
def han_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the segmenter as its tokenizer."""
    rows = _han(spark).where(F.col("text").rlike(r"^[\x{4E00}-\x{9FFF}]+$")).withColumn("ord", F.col("no"))
    tokens = segment.chinese_tokens()
    asked = spark.createDataFrame([(1, "对话框")], "query_id int, text string")
    found = bm25.scores(bm25.build(rows, F.col("text"), tokens), bm25.query_tokens(asked, F.col("text"), tokens))
    return found.select(F.col("query_id").cast("int").alias("query_id"), F.col("ord").cast("int").alias("no"), "score")


# Tokens and lexical statistics ---------------------------------------------


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def tokens_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.lexical_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT item_id, array_to_string({sql_terms('text')}, ' ') AS tokens FROM benchmark")
def tokens_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.array_join(text.query_terms(F.col("text"), stemming=False), " ").alias("tokens"))


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    docs = documents(spark, sf_dir)
    return bm25.build(docs, text.retrieval_text(F.col("comments")))


@query(f"WITH {_DOCS} SELECT doc_id, dl::INTEGER AS dl FROM dl")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).docs.select(F.col("ord").alias("doc_id"), "dl")


@query(f"WITH {_DOCS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_DOCS}, {_TF} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).frequencies


@query(f"WITH {_DOCS}, {_TF} SELECT doc_id, term, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.withColumnRenamed("ord", "doc_id")


@query(f"WITH {_DOCS}, {_TF} SELECT term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, st")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    both = index.frequencies.crossJoin(F.broadcast(index.stats))
    return both.select("term", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_BM25} SELECT item_id, doc_id, score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = bm25.query_tokens(items(spark, sf_dir), F.col("text"))
    return bm25.scores(_index(spark, sf_dir), terms).select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(_index(spark, sf_dir), items(spark, sf_dir), F.col("text"), 5)


@query(f"WITH {_RANKED} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM ranked")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


@query("SELECT 0 AS query_id, doc_id, 0.0::DOUBLE AS score, (row_number() OVER (ORDER BY doc_id))::INTEGER AS rank FROM documents QUALIFY rank <= 5")
def bm25_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without a known term gets the first documents."""
    none = spark.range(1).select(F.lit(0).alias("query_id"), F.lit("zzzzqqqq").alias("text"))
    return bm25.search(_index(spark, sf_dir), none, F.col("text"), 5).select("query_id", F.col("ord").alias("doc_id"), "score", "rank")


# TF-IDF --------------------------------------------------------------------

_VOCAB = f"v AS (SELECT DISTINCT unnest({sql_terms('text')}) AS term FROM documents)"


@query(f"WITH {_VOCAB} SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({sql_terms('text')}) AS term FROM benchmark) JOIN v USING (term) GROUP BY ALL")
def query_tf_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(text.query_terms(F.col("text"), stemming=False)).alias("term")).distinct()
    asked = tfidf.query_vector(items(spark, sf_dir), text.query_terms(F.col("text"), stemming=False), words.withColumn("idx", F.col("term")))
    return asked.select(F.col("query_id").alias("item_id"), F.col("idx").alias("term"), "tf")


@query(f"""WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents) GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM c GROUP BY term),
q AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({sql_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
wd AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term)), wq AS (SELECT item_id, term, tf * idf AS w FROM q JOIN i USING (term)),
nd AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM wd GROUP BY doc_id), nq AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM wq GROUP BY item_id),
m AS (SELECT item_id, doc_id, round(sum(wq.w / nq.n * wd.w / nd.n), 6) AS score FROM wq JOIN wd USING (term) JOIN nd USING (doc_id) JOIN nq USING (item_id) GROUP BY item_id, doc_id),
s AS (SELECT b.item_id, d.doc_id, coalesce(score, 0.0::DOUBLE) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN m ON m.item_id = b.item_id AND m.doc_id = d.doc_id)
SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tfidf.search(documents(spark, sf_dir), F.col("text"), items(spark, sf_dir), F.col("text"), 5, stemming=False)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


@query("""WITH v AS (SELECT label, dim - 1 AS dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim),
q AS (SELECT item_id, ascii(c) - 97 AS dim, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(string_split(lower(text), '')) AS c FROM benchmark) WHERE c BETWEEN 'a' AND 'z' GROUP BY ALL),
m AS (SELECT item_id, label, sum(n * x) / (any_value(qn) * any_value(vn)) AS score FROM q JOIN v USING (dim) JOIN (SELECT item_id, sqrt(sum(n * n)) AS qn FROM q GROUP BY item_id) USING (item_id)
  JOIN (SELECT label, sqrt(sum(x * x)) AS vn FROM v WHERE dim < 26 GROUP BY label) USING (label) WHERE label IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) GROUP BY item_id, label)
SELECT item_id, label::VARCHAR AS key, round(score, 6) AS score, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, label))::INTEGER AS rank FROM m QUALIFY rank <= 3""")
def tfidf_model_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of given weights: letters as its vocabulary, labels as its keys, mean vectors as weights; every third key is unknown to the corpus."""
    cells = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).where("dim < 26")
    mean = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")).toPandas()  # a model: 26 weights a label
    matrix = mean.pivot(index="label", columns="dim", values="x").sort_index()
    keys = spark.createDataFrame([(i, str(label)) for i, label in enumerate(matrix.index)], "idx int, key string")
    letters = spark.createDataFrame([(chr(97 + i), i) for i in range(26)], "term string, idx int")
    model = tfidf.Model(letters, keys, tfidf.weights_score(matrix.to_numpy()))
    asked = items(spark, sf_dir).select("query_id", F.regexp_replace(F.lower("text"), "([a-z])", "$1 ").alias("text"))
    known = documents(spark, sf_dir).where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("id"))
    found = tfidf.model_search(model, asked, F.col("text"), 3, stemming=False, corpus=known, stop_words=())
    return found.select(F.col("query_id").alias("item_id"), "key", "score", "rank")


# Chunks and vectors --------------------------------------------------------


@query(f"""WITH {_DOCS}, c AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(0, (greatest(ceil((len(ws) - 512) / 462.0), 0) * 462)::BIGINT + 1, 462) END) AS start FROM d)
SELECT doc_id, start::INTEGER AS start, len(list_slice(ws, start + 1, start + 512))::INTEGER AS n FROM c""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).docs.select(F.col("ord").alias("doc_id"), "tokens", F.explode(vector.chunk_starts(F.size("tokens"))).alias("start"))
    return rows.select("doc_id", "start", F.size(F.slice("tokens", F.col("start") + 1, 512)).alias("n"))


@query(f"""WITH {_DOCS}, i AS (SELECT doc_id, list_transform(ws, lambda x: length(x)::INTEGER) AS ids FROM d)
SELECT doc_id, len(p)::INTEGER AS n, list_sum(p)::BIGINT AS sum_ids, least(len(ids), 512)::BIGINT AS sum_mask FROM (SELECT doc_id, ids, list_resize(list_slice(ids, 1, 512), 512, 0) AS p FROM i)""")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for sub-word ids."""
    ids = _index(spark, sf_dir).docs.select(F.col("ord").alias("doc_id"), F.transform("tokens", F.length).alias("ids"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    p, m = vector.padded(F.col("ids")), vector.attention_mask(F.col("ids"))
    return ids.select("doc_id", F.size(p).alias("n"), total(p).alias("sum_ids"), total(m).alias("sum_mask"))


@query("""SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY label, dim""")
def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask is 0 for every third vector."""
    rows = read(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    cells = rows.where("mask = 1").select("label", F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""SELECT vec_id, dim::INTEGER AS dim, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x, generate_subscripts(embedding, 1) - 1 AS dim,
  sqrt(list_sum(list_transform(embedding, lambda v: (v::DOUBLE * 3) * (v::DOUBLE * 3)))) AS n FROM embeddings)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.l2_normalize(scaled)).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (every twentieth) and chunk vectors (label as document)."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return asked, rows.select(F.col("label").cast("long").alias("ord"), "vec_id", F.col("embedding").alias("vec"))


_DOT = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_BEST = f"""WITH s AS (SELECT q.vec_id AS query_id, c.label::BIGINT AS label, round(max({_DOT}), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, label, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label))::INTEGER AS rank FROM s QUALIFY rank <= 5"""


@query(f"SELECT q.vec_id AS query_id, c.vec_id, round({_DOT}, 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0")
def dot_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = _vectors(spark, sf_dir)
    return dense.pair_scores(asked, chunks, "vec_id")


@query(_BEST)
def max_over_chunks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = _vectors(spark, sf_dir)
    return dense.search(asked, chunks, 5).select("query_id", F.col("ord").alias("label"), "score", "rank")


@query(_BEST)
def dense_topk_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = _vectors(spark, sf_dir)
    return dense.blocked_search(asked, chunks, 5).select("query_id", F.col("ord").alias("label"), "score", "rank")


# Evaluation ----------------------------------------------------------------

_EXPECT = "x AS (SELECT b.item_id, min(d.doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"
_GRADED = f"""WITH {_RANKED}, {_EXPECT}, g AS (SELECT x.item_id, x.expected, coalesce(CASE WHEN rank <= 5 THEN pow(2.0::DOUBLE, 1 - rank) END, 0.0::DOUBLE) AS score,
  CASE WHEN {_HAN.replace('text', 'b.text')} > 0 AND {_LATIN.replace('text', 'b.text')} = 0 THEN 'zh-cn' ELSE 'en' END AS lang, d.source AS key, b.text AS query
  FROM x JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = x.expected LEFT JOIN ranked r ON r.item_id = x.item_id AND r.doc_id = x.expected)"""


#: Queries that are looked for at once, and characters from their middle by which texts are picked.
_SOUGHT, _MIDDLE = 500, 16


def _holding(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, ord) of the documents that hold a query's text.

    One pass over the texts for each ``_SOUGHT`` queries: an expression of the
    middles of all of them picks the texts that may hold one, and those are searched.
    """
    spark = docs.sparkSession
    kind = asked.schema["item_id"].dataType
    rows = asked.select("item_id", "text").where("text IS NOT NULL").collect()  # a stated query set
    literal = lambda t: "".join(c if c.isalnum() or not c.isascii() else f"\\x{{{ord(c):x}}}" for c in t)

    def against(rows: list) -> DataFrame:
        middles = {t[(at := max(0, (len(t) - _MIDDLE) // 2)) : at + _MIDDLE] for _, t in rows}
        shared = spark.sparkContext.broadcast((pa.array([i for i, _ in rows], to_arrow_type(kind)), [t for _, t in rows], "|".join(map(literal, sorted(middles)))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, sought, pattern = shared.value
            for batch in batches:
                may = batch.filter(pc.match_substring_regex(batch.column(1), pattern))
                at, ords = [], []
                for o, t in zip(may.column(0), may.column(1), strict=True):
                    t = t.as_py()
                    own = [i for i, s in enumerate(sought) if s in t]
                    at += own
                    ords += [o.as_py()] * len(own)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(ords, pa.int64())], names=["item_id", "ord"])

        return docs.select(F.col("ord").cast("long").alias("ord"), "text").mapInArrow(run, T.StructType([T.StructField("item_id", kind), T.StructField("ord", T.LongType())]))

    parts = [against(rows[i : i + _SOUGHT]) for i in range(0, len(rows), _SOUGHT)]
    return reduce(DataFrame.union, parts) if parts else asked.select("item_id").crossJoin(docs.select("ord")).limit(0)


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = documents(spark, sf_dir), items(spark, sf_dir)
    index = _index(spark, sf_dir)
    # One row at most for each query.
    first = _holding(docs, asked).groupBy("item_id").agg(F.min("ord").alias("expected")).join(asked, "item_id")
    cases = docs.select(F.col("doc_id").alias("expected"), F.col("source").alias("key")).join(F.broadcast(first), "expected")
    cases = cases.select(F.col("item_id").alias("query_id"), "expected", lang.route(F.col("text")).alias("lang"), "key", F.col("text").alias("query"))
    return evaluate.grade(cases, bm25.search(index, asked, F.col("text"), 5))


@query(f"{_GRADED} SELECT item_id, expected, score FROM g")
def graded_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(F.col("query_id").alias("item_id"), "expected", "score")


@query(f"{_GRADED} SELECT lang, key, round(avg(score), 6) AS avg_score, count(*) AS sample_size FROM g GROUP BY lang, key")
def key_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.key_means(_graded(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


@query(f"{_GRADED} SELECT lang, round(avg(a), 6) AS total_avg FROM (SELECT lang, key, avg(score) AS a FROM g GROUP BY lang, key) GROUP BY lang")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_means(evaluate.key_means(_graded(spark, sf_dir))).withColumn("total_avg", F.round("total_avg", 6))


@query(f"""{_GRADED}, k AS (SELECT lang, key, avg(score) AS a FROM g GROUP BY lang, key), l AS (
  SELECT DISTINCT lang, 0 AS part, NULL AS key, 0 AS sub, NULL AS query, 'LANGUAGE: ' || upper(lang) AS line FROM k
  UNION ALL SELECT DISTINCT lang, 0, NULL, 1, NULL, repeat('-', 42) FROM k
  UNION ALL SELECT lang, 1, key, 2, NULL, '' FROM k
  UNION ALL SELECT DISTINCT lang, 2, NULL, 1, NULL, repeat('=', 42) FROM k
  UNION ALL SELECT DISTINCT lang, 2, NULL, 2, NULL, '' FROM k
  UNION ALL SELECT lang, 1, key, 0, NULL, 'Key: ' || key || ' (Avg: ' || printf('%.4f', a) || ')' FROM k
  UNION ALL SELECT lang, 1, key, 1, query, '  - [Score: ' || rpad(CASE score WHEN 1 THEN '1' WHEN 0 THEN '0' WHEN 0.5 THEN '0.5' WHEN 0.25 THEN '0.25' WHEN 0.125 THEN '0.125' ELSE '0.0625' END, 6, ' ') || '] Query: ' || query FROM g
  UNION ALL SELECT lang, 2, NULL, 0, NULL, '>> TOTAL AVERAGE FOR ' || upper(lang) || ': ' || printf('%.4f', avg(a)) FROM k GROUP BY lang)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY part, key NULLS FIRST, sub, query NULLS FIRST, line))::INTEGER AS no, line FROM l""")
def eval_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_lines(_graded(spark, sf_dir))


# Joins, assembly, storage --------------------------------------------------


@query(f"""WITH {_RANKED} SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM every WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY rank <= 5""")
def known_key_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of the known documents: others drop out before they are ranked."""
    known = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    found = bm25.search(_index(spark, sf_dir), items(spark, sf_dir), F.col("text"), 5, known=known)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


@query("""SELECT doc_id, replace(nfc_normalize(text) || chr(10) || 'snippet ' || source, chr(10), chr(10) || repeat(' ', (doc_id % 5)::BIGINT)) AS insert_text FROM documents""")
def insert_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an item: its lines as comments, one snippet, an indent by its id."""
    docs = documents(spark, sf_dir).withColumn("comments", assemble.nfc_lines("comments"))
    indent = F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int"))
    snippets = F.array(F.concat(F.lit("snippet "), "source"))
    return docs.select("doc_id", assemble.insert_text(F.col("comments"), snippets, indent).alias("insert_text"))


@query("""SELECT doc_id, (doc_id % 100)::INTEGER AS insert_line, greatest(doc_id % 3, 1)::INTEGER AS insert_character, (doc_id % 100)::INTEGER AS remove_from,
  (doc_id % 100 + len(string_split(text, chr(10))))::INTEGER AS remove_to FROM documents""")
def edit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, character = (F.col("doc_id") % 100).cast("int"), (F.col("doc_id") % 3).cast("int")
    ranges = assemble.edit_ranges(line, character, F.col("comments"))
    return documents(spark, sf_dir).select("doc_id", *[c.cast("int").alias(n) for n, c in ranges.items()])


@query("SELECT label::BIGINT AS label, count(*) AS chunks, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY label")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense index saved and loaded again."""
    rows = read(spark, sf_dir, "embeddings").withColumn("lang", F.lit("en"))
    index = rows.select("lang", F.col("vec_id").alias("ord"), F.col("label").cast("long").alias("label"), F.array("embedding").alias("embeddings"))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # one machine, as in tests
        folder = tempfile.mkdtemp(prefix="sparklode-index-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
    path = f"{base}/index-{os.urandom(8).hex()}"
    source.save_index(index, path)
    chunks = dense.exploded(source.load_index(spark, path), "label")
    return chunks.groupBy("label").agg(F.count("*").alias("chunks"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))), 4).alias("total"))


# Without SQL ---------------------------------------------------------------


@query()
def porter_stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each different query term."""
    words = items(spark, sf_dir).select(F.explode(text.query_terms(F.col("text"), stemming=False)).alias("word")).distinct()
    return words.select("word", text.stem_all(F.array("word"))[0].alias("stem"))


def stub_tokenizer(line: str) -> list[int]:
    """Word hashes as ids, where no model file is given."""
    return [sum(w.encode()) % 997 + 1 for w in line.lower().split()]


def stub_encoder(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Fixed pseudo-random hidden states by id, where no model file is given."""
    table = np.random.default_rng(3).normal(0, 1, (998, 32))
    return table[ids]


@query()
def stub_encoder_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, encode, pool, search: the dense flow with a stand-in encoder."""
    index = dense.build_index(documents(spark, sf_dir).select("ord", "comments"), stub_tokenizer, stub_encoder)
    asked = dense.encode_queries(items(spark, sf_dir).select("query_id", "text"), stub_tokenizer, stub_encoder).where("vec IS NOT NULL")
    found = dense.blocked_search(asked, dense.exploded(index), 5)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


@query()
def completion_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completion flow over all lines of the benchmark texts in braces, answered by BM25."""
    docs = documents(spark, sf_dir)
    corpus = docs.select(lang.route(F.col("text")).alias("lang"), "ord", F.col("doc_id").cast("string").alias("id"), "comments", F.array("source").alias("snippets"))
    lines = _brace_lines(spark, sf_dir).select(F.concat(F.lit("benchmark/"), "item_id").alias("doc_path"), (F.col("no") + 1).alias("line_no"), F.lit(0).alias("character"), "before")

    def search(asked: DataFrame) -> DataFrame:
        found = bm25.search(bm25.build(corpus, text.retrieval_text(F.col("comments"))), asked, F.col("text"), 5)
        return found.join(asked.select("query_id", "lang"), "query_id")

    return assemble.completions(lines, corpus, search, ["en"])

