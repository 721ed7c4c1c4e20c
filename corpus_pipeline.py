"""Corpus pipeline: five stages over documents, each one operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet to the shared folder and reread. All but
the last return the columns of documents; the last one the token ids.

Edge cases: an empty table stays empty through all stages. Null and empty texts
are judged by the classifiers like any text, are nobody's copy, hold no
benchmark item and have no tokens; rows without an id, and rows of one id with
unlike texts, are documents of their own. Texts of any length are read whole,
and further columns are passed through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparklode.llm import byte_bpe, decontaminate, ngram_join, quality, toxicity
from sparklode.llm.common import stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score under 0.3 go."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")), 0.3)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and the ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", encoding),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
