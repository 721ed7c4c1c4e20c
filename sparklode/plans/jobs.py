"""Whole jobs: building indexes of several languages, searching and evaluating them.

Every engine answers alike: ``search(queries, k)`` takes (query_id, text) and
gives (query_id, ord, id, score, rank). A dictionary from language to engine
answers queries of all languages (``search_all``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens, retrieval_text
from ..operators import bm25, dense, evaluate, tfidf
from ..sources import corpus as source


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, ord, id, score, rank) for (query_id, text)."""

    def require(self) -> None:
        """An error if there is nothing to search."""


def _named(found: DataFrame, corpus: DataFrame) -> DataFrame:
    ids = corpus.select(F.col("ord").cast("long").alias("ord"), "id")
    return found.join(ids, "ord").select("query_id", "ord", "id", "score", "rank")


@dataclass
class Lexical:
    """BM25 over the documents of a corpus (ord, id, comments, snippets) that have something to insert."""

    corpus: DataFrame
    tokenizer: Callable[[Column], Column] = lexical_tokens
    k1: float = bm25.K1
    b: float = bm25.B

    @classmethod
    def create(cls, spark: SparkSession, path: str, **options) -> Lexical:
        return cls(source.read_corpus(spark, path), **options)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        index = bm25.build(self.corpus, retrieval_text(F.col("comments")), self.tokenizer, self.k1, self.b)
        return _named(bm25.search(index, queries, F.col("text"), k, self.tokenizer), self.corpus)

    def require(self) -> None:
        evaluate.require_index(self.corpus)


@dataclass
class Weighted:
    """A TF-IDF model over the keys that its corpus (id) holds."""

    model: tfidf.Model
    corpus: DataFrame

    @classmethod
    def create(cls, spark: SparkSession, info: str, score: Callable, path: str) -> Weighted:
        return cls(tfidf.Model.load(spark, info, score), source.read_corpus(spark, path))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        found = tfidf.model_search(self.model, queries, F.col("text"), k, corpus=self.corpus)
        return found.select("query_id", "ord", F.col("key").alias("id"), "score", "rank")

    def require(self) -> None:
        evaluate.require_index(self.corpus)


@dataclass
class Dense:
    """Chunk vectors (ord, id, embeddings) and the encoder they were made with."""

    index: DataFrame
    tokenizer: dense.Tokenizer
    encoder: dense.Encoder

    @classmethod
    def build(cls, spark: SparkSession, path: str, tokenizer: dense.Tokenizer, encoder: dense.Encoder) -> Dense:
        return cls(dense.build_index(source.read_corpus(spark, path), tokenizer, encoder), tokenizer, encoder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: dense.Tokenizer, encoder: dense.Encoder) -> Dense:
        return cls(source.load_index(spark, path), tokenizer, encoder)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        asked = dense.encode_queries(queries.select("query_id", "text"), self.tokenizer, self.encoder).where("vec IS NOT NULL")
        found = dense.blocked_search(asked, dense.exploded(self.index), k)
        return _named(dense.fill_up(found, asked, self.index.select(F.col("ord").cast("long").alias("ord"), "embeddings"), k), self.index)

    def require(self) -> None:
        evaluate.require_index(self.index)


def search_all(queries: DataFrame, engines: dict[str, Retriever], k: int = 5) -> DataFrame:
    """(lang, query_id, ord, id, score, rank): each query (query_id, lang, text) by the engine of its language; others give nothing (``unanswered``)."""
    parts = [e.search(queries.where(F.col("lang") == lang), k).select(F.lit(lang).alias("lang"), "query_id", "ord", "id", "score", "rank") for lang, e in engines.items()]
    return reduce(DataFrame.unionByName, parts)


def unanswered(queries: DataFrame, engines: dict[str, Retriever]) -> DataFrame:
    """The queries whose language has no engine."""
    return queries.where(~F.coalesce(F.col("lang").isin(list(engines)), F.lit(False)))


def build_all(spark: SparkSession, corpora: dict[str, tuple[str, dense.Tokenizer, dense.Encoder]], path: str) -> DataFrame:
    """Index folders by language of several corpus files, each with its own tokenizer and encoder."""
    parts = [dense.build_index(source.read_corpus(spark, file, lang), tokenizer, encoder) for lang, (file, tokenizer, encoder) in corpora.items()]
    source.save_index(reduce(DataFrame.unionByName, parts), path)
    return source.load_index(spark, path)


def load_all(spark: SparkSession, path: str, encoders: dict[str, tuple[dense.Tokenizer, dense.Encoder]]) -> dict[str, Retriever]:
    """An engine for each language of saved index folders; only a language's own folder is read for it."""
    index = source.load_index(spark, path)
    return {lang: Dense(index.where(F.col("lang") == lang).drop("lang"), *own) for lang, own in encoders.items()}


def run_eval(spark: SparkSession, cases: str, engines: dict[str, Retriever], k: int = 5, report: str | None = None) -> DataFrame:
    """The graded cases (query_id, lang, key, query, expected, score) of a file; writes the report if a path is given.

    Cases of a language without an engine are skipped; an empty index is an error.
    """
    for engine in engines.values():
        engine.require()
    asked = source.read_cases(spark, cases).select(F.col("no").cast("long").alias("query_id"), "lang", "key", "query", F.col("key").alias("expected"))
    asked = asked.where(F.col("lang").isin(list(engines)))
    found = search_all(asked.select("query_id", "lang", F.col("query").alias("text")), engines, k)
    graded = evaluate.grade(asked, found.select("query_id", F.col("id").alias("ord"), "rank"))
    if report:
        source.write_report(evaluate.full_report(graded), report)
    return graded
