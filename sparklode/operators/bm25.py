"""BM25 over an inverted index held in DataFrames, many queries a job.

score(q, d) = sum over the query's tokens, repeated ones repeatedly, of
idf * f (k1 + 1) / (f + k1 (1 - b + b dl / avgdl)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

Two passes over the documents, and no shuffle of tokens: one counts what the
queries' words need (n, total length, document frequencies), the other scores
every document where it is read, in slices of Arrow batches that bound the memory,
and keeps the best k of a task. The queries' words are sent to the tasks up to ``BROADCAST_TERMS`` rows;
beyond that postings and words are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..functions.text import lexical_lists, lexical_tokens
from ..sources.corpus import has_snippets

K1, B = 1.5, 0.75
#: Rows (query, word) of queries that are sent to the tasks.
BROADCAST_TERMS = 200_000
#: Cells (query, document) that are scored at once, (query, word, document) too, and tokens that are looked up at once.
CELLS = 500_000
#: Documents to which a search is restricted where they are read; more are restricted by a join of what was found.
KNOWN = 2_000_000


@dataclass
class Index:
    """``docs`` (ord, tokens, dl), the rest derived from it."""

    docs: DataFrame
    k1: float = K1
    b: float = B
    #: (ord, text) to be cut into ``lexical_tokens`` where it is read, if that is the tokenizer
    texts: DataFrame | None = None

    @property
    def source(self) -> DataFrame:
        """(ord, tokens), or (ord, text), of which ``token_lists`` makes tokens."""
        return self.docs.select("ord", "tokens") if self.texts is None else self.texts

    @property
    def stats(self) -> DataFrame:
        """One row: n and avgdl (null without documents)."""
        return self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    @property
    def postings(self) -> DataFrame:
        """(ord, term, tf)."""
        return self.docs.select("ord", F.explode("tokens").alias("term")).groupBy("ord", "term").agg(F.count("*").alias("tf"))

    @property
    def frequencies(self) -> DataFrame:
        """(term, df)."""
        return self.docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build(corpus: DataFrame, text: Column, tokenizer=lexical_tokens, k1: float = K1, b: float = B, snippets: str | None = "snippets") -> Index:
    """An index of the rows of ``corpus`` (column ``ord``); ``tokenizer`` maps a text column to a token array.

    Documents that have nothing to insert are left out, if ``corpus`` has the array column ``snippets``.
    """
    if snippets in corpus.columns:
        corpus = corpus.where(has_snippets(F.col(snippets)))
    docs = corpus.select(F.col("ord").cast("long").alias("ord"), tokenizer(text).alias("tokens"))
    texts = corpus.select(F.col("ord").cast("long").alias("ord"), text.alias("text")) if tokenizer is lexical_tokens else None
    return Index(docs.withColumn("dl", F.size("tokens")), k1, b, texts)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def query_tokens(queries: DataFrame, text: Column, tokenizer=lexical_tokens) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(tokenizer(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def counts_of(tokens: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, times) of those tokens of the batch that are among ``words``."""
    at = pc.index_in(tokens.flatten(), words)
    owner = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    held = at.is_valid().to_numpy(zero_copy_only=False)
    cell, times = np.unique(owner[held] * len(words) + at.drop_null().to_numpy(), return_counts=True)
    return cell // len(words), cell % len(words), times


def token_lists(column: pa.Array) -> pa.ListArray:
    """A column of token lists as it is, one of texts as the tokens that ``lexical_tokens`` makes of them."""
    return lexical_lists(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``CELLS`` tokens or bytes of text, so that memory doesn't grow with the documents of a batch."""
    size = pc.list_value_length if pa.types.is_list(batch.column(column).type) else pc.binary_length
    turn = np.cumsum(pc.fill_null(size(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // CELLS
    bounds = np.append(np.flatnonzero(np.append(True, turn[1:] != turn[:-1])) if len(turn) else 0, len(turn))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def sums(docs: int, doc: np.ndarray, word: np.ndarray, part: np.ndarray, first: np.ndarray, query: np.ndarray, w: np.ndarray, asked: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, query, sum) of part * weight over the words they share, some documents at a time.

    ``doc`` (sorted), ``word`` and ``part`` are the words of documents, ``query`` and ``w`` the queries of each word from ``first`` on; all parts and weights are positive.
    """
    times = (first[1:] - first[:-1])[word]
    load = np.maximum(np.bincount(doc, weights=times, minlength=docs), asked)
    turn = (np.cumsum(load) // CELLS).astype(np.int64)
    bounds = np.append(np.flatnonzero(np.append(True, turn[1:] != turn[:-1])) if docs else 0, docs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = slice(*np.searchsorted(doc, [a, b]))
        n = times[own]
        pair = np.repeat(first[word[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(doc[own] - a, n) * asked + query[pair]
        found = np.bincount(cell, weights=np.repeat(part[own], n) * w[pair], minlength=(b - a) * asked)
        hit = np.flatnonzero(found)
        yield a + hit // asked, hit % asked, found[hit]


def term_stats(docs: DataFrame, words: pa.Array) -> tuple[int, float, np.ndarray]:
    """Of an index's ``source``: documents, their total length and the document frequency of each of ``words``, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            n += len(batch)
            for piece in pieces(batch, 0):
                tokens = token_lists(piece.column(0))
                total += pc.sum(pc.list_value_length(tokens)).as_py() or 0
                df += np.bincount(counts_of(tokens, shared.value)[1], minlength=len(df)) if len(df) else 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], names=["no", "count"])

    found = docs.drop("ord").mapInArrow(run, "no long, count long").groupBy("no").agg(F.sum("count").alias("count"))
    counted = {r["no"]: r["count"] for r in found.collect()}  # a row for each word, BROADCAST_TERMS at most
    return counted.get(-1, 0), counted.get(-2, 0), np.array([counted.get(i, 0) for i in range(len(words))], np.int64)


def scores(index: Index, terms: DataFrame, k: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(query_id, ord, score) of all pairs that share a term, rounded to six places; with ``k`` the best k of each task at least.

    Only documents among ``known`` (ord), few enough to be sent to the tasks, are scored where they are read; statistics are of all documents.
    """
    spark = index.docs.sparkSession
    # Up to the limit is read; if there is more, it isn't used.
    rows = terms.select(F.col("query_id").cast("long").alias("query_id"), "term", "qtf").limit(BROADCAST_TERMS + 1).toPandas()
    if len(rows) > BROADCAST_TERMS:
        return joined_scores(index, terms)
    names, no = np.unique(rows["term"].to_numpy(str), return_inverse=True) if len(rows) else (np.zeros(0, str), np.zeros(0, np.int64))
    words = pa.array(names.tolist(), pa.string())
    n, total, df = term_stats(index.source, words)
    ids, query = np.unique(rows["query_id"].to_numpy(np.int64), return_inverse=True)
    w = rows["qtf"].to_numpy(float) * np.log(1 + (n - df[no] + 0.5) / (df[no] + 0.5))
    # Words by number, each with its queries and their weights.
    by = np.argsort(no, kind="stable")
    first = np.searchsorted(no[by], np.arange(len(words) + 1))
    shared = spark.sparkContext.broadcast((words, first, query[by], w[by], ids))
    k1, b, mean = index.k1, index.b, total / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, query, w, ids = shared.value
        if not len(ids):
            return
        best = Best(len(ids), k) if k else None
        for whole in batches:
            for batch in pieces(whole, 1):
                tokens = token_lists(batch.column(1))
                doc, word, tf = counts_of(tokens, words)
                dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(float)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / max(mean, 1e-9)))
                ords = batch.column(0).to_numpy()
                for row, q, score in sums(len(batch), doc, word, part, first, query, w, len(ids)):
                    score = np.round(score, 6)
                    if best:
                        best.add(q, ords[row], score)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ords[row]), pa.array(score)], names=["query_id", "ord", "score"])
        if best:
            q, ords, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ords), pa.array(score)], names=["query_id", "ord", "score"])

    docs = index.source if known is None else index.source.join(F.broadcast(known), "ord", "left_semi")
    return docs.mapInArrow(run, "query_id long, ord long, score double")


class Best:
    """The best k (ord, score) of each query, ties by ord; rows are held until they are many and then cut."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, max(250_000, 4 * queries * k)
        self.least = np.full(queries, -np.inf)  # the k-th score of each query so far
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, query: np.ndarray, ords: np.ndarray, score: np.ndarray) -> None:
        able = score >= self.least[query]
        self.held.append((query[able], ords[able], score[able]))
        self.size += int(able.sum())
        if self.size > self.limit:
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...]:
        query, ords, score = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # A document counts once, by its best score.
        by = np.lexsort((-score, ords, query))
        query, ords, score = query[by], ords[by], score[by]
        if len(query):
            once = np.concatenate([[True], (query[1:] != query[:-1]) | (ords[1:] != ords[:-1])])
            query, ords, score = query[once], ords[once], score[once]
        by = np.lexsort((ords, -score, query))
        query, ords, score = query[by], ords[by], score[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep, last = rank < self.k, rank == self.k - 1
        self.least[query[last]] = score[last]
        self.held = [(query[keep], ords[keep], score[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def joined_scores(index: Index, terms: DataFrame) -> DataFrame:
    """As ``scores``, by joins: for more query words than are sent to tasks.

    Postings of terms that no query has are dropped before they are counted.
    """
    wanted = terms.select("term").distinct()
    tokens = index.docs.select("ord", "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    postings = tokens.groupBy("term", "ord", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = terms.join(df, "term").crossJoin(F.broadcast(index.stats))  # stats is one row
    weight = weight.select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"))
    part = F.col("w") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b)
    return postings.join(weight, "term").groupBy("query_id", "ord").agg(F.round(F.sum(part), 6).alias("score"))


def search(index: Index, queries: DataFrame, text: Column, k: int = 10, tokenizer=lexical_tokens, known: DataFrame | None = None) -> DataFrame:
    """(query_id, ord, score, rank): the best k documents of each query; ``known`` (ord) restricts them before ranking.

    Queries with fewer matches are filled up with documents of score 0 in
    order, as all documents have a score.
    """
    queries = queries.select("query_id", text.alias("__text"))
    terms, docs = query_tokens(queries, F.col("__text"), tokenizer), index.docs.select("ord")
    if known is None:
        found = scores(index, terms, k)
    else:
        known = known.select(F.col("ord").cast("long").alias("ord")).distinct()
        few = known.limit(KNOWN + 1).count() <= KNOWN
        found = scores(index, terms, k, known) if few else scores(index, terms)
        found, docs = found.join(known, "ord", "left_semi"), docs.join(known, "ord", "left_semi")
    # A query with m < k matches needs k - m others: they are among the first 2k documents.
    first = docs.orderBy("ord").limit(2 * k)
    fill = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    best = top_k(found.select("query_id", "ord", "score"), k, "query_id").drop("rank")
    # Among equal pairs the match counts.
    both = best.unionByName(fill).groupBy("query_id", "ord").agg(F.max("score").alias("score"))
    return top_k(both, k, "query_id")
