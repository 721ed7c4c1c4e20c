"""The pipeline's stages against its operators and brute force, and its edges."""

import os

import pytest
from test_join import brute

import corpus_pipeline
from sparklode.llm import queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == before.columns
        assert docs.join(before, docs.columns, "left_anti").count() == 0
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            wanted = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])}
    scored = {r["doc_id"] for r in queries.op3_quality(spark, SF).where("predicted = 1").collect()}
    assert kept["quality classifier"] == scored
    assert kept["n-gram Jaccard join"] == wanted
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == kept["benchmark decontamination"]


@tables
def test_stages_take_empty_and_odd_tables(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    key = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    assert key(corpus_pipeline.quality_filter(spark, odd, SF)) <= key(odd)
    docs = corpus_pipeline.toxicity_filter(spark, odd, SF)
    assert docs.columns == odd.columns and docs.count() == odd.count()  # none of these is toxic
    docs = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["0", "1", "10", "2", "3", "6", "7", "8", "9", "None"]
    docs = corpus_pipeline.decontamination(spark, docs, SF)
    assert docs.count() == 10
    last = corpus_pipeline.encoding(spark, docs, SF).collect()
    assert len(last) == 10 and {r["n_tokens"] for r in last if r["doc_id"] in (1, 2)} == {0}


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
