"""Indexes, search, evaluation, assembly, storage and serving on small fixtures."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sparklode.functions import lang, segment
from sparklode.operators import assemble, bm25, dense, evaluate, tfidf
from sparklode.plans import jobs, registry
from sparklode.plans.registry import QUERIES, stub_encoder, stub_tokenizer
from sparklode.sources import corpus as source
from sparklode.streaming.serve import serve

TEXTS = ["Draw a filled circle", "Draw an empty box, box outline", "Née arc", "Draw a filled circle"]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build(spark.createDataFrame(list(enumerate(TEXTS)), "ord long, text string"), F.col("text"))


@pytest.mark.parametrize(
    ("query", "scores", "order"),
    [
        ("draw box", [0.366373, 1.819844, 0, 0.366373], [1, 0, 3, 2]), ("box box", [0, 3.037853, 0, 0], [1, 0, 2, 3]),
        ("zzz", [0, 0, 0, 0], [0, 1, 2, 3]), ("", [0, 0, 0, 0], [0, 1, 2, 3]), ("NÉE", [0, 0, 2.775259, 0], [2, 0, 1, 3]), ("constructor", [0, 0, 0, 0], [0, 1, 2, 3]),
    ],
)
def test_bm25(spark, index, query, scores, order):
    asked = spark.createDataFrame([(7, query)], "query_id long, text string")
    found = bm25.search(index, asked, F.col("text"), 10).orderBy("rank").collect()
    assert [r["ord"] for r in found] == order
    assert [r["score"] for r in found] == pytest.approx([scores[i] for i in order], abs=2e-6)
    assert [r["ord"] for r in bm25.search(index, asked, F.col("text"), 2).orderBy("rank").collect()] == order[:2]


def test_bm25_statistics_and_empty_corpus(spark, index):
    assert index.stats.collect()[0].asDict() == {"n": 4, "avgdl": 4.25}
    assert {r["term"]: r["df"] for r in index.frequencies.collect()}["draw"] == 3
    none = bm25.build(spark.createDataFrame([], "ord long, text string"), F.col("text"))
    assert bm25.search(none, spark.createDataFrame([(1, "draw")], "query_id long, text string"), F.col("text")).count() == 0


def test_tfidf_known_keys_and_stems(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "ord long, text string")
    asked = spark.createDataFrame([(1, "drawing circles")], "query_id long, text string")
    found = tfidf.search(docs, F.col("text"), asked, F.col("text")).orderBy("rank").collect()
    assert [r["ord"] for r in found] == [0, 3, 1, 2] and found[-1]["score"] == 0  # all documents are ranked
    only = tfidf.search(docs, F.col("text"), asked, F.col("text"), known=docs.where("ord > 0"))
    assert [r["ord"] for r in only.orderBy("rank").collect()] == [3, 1, 2]


@pytest.mark.parametrize("module", [bm25, tfidf])
def test_more_words_than_are_sent_are_joined(spark, monkeypatch, module):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "ord long, text string")
    asked = spark.createDataFrame([(1, "draw a circle box"), (2, "box box arc"), (3, "née")], "query_id long, text string")

    def found():
        rows = bm25.search(bm25.build(docs, F.col("text")), asked, F.col("text"), 3) if module is bm25 else tfidf.search(docs, F.col("text"), asked, F.col("text"), 3)
        return [tuple(r) for r in rows.orderBy("query_id", "rank").collect()]

    before = found()
    monkeypatch.setattr(module, "BROADCAST_TERMS", 2)
    assert found() == before and len(before) == 9


def test_bm25_parameters_and_known_documents(spark):
    docs = spark.createDataFrame([(i, t, ["x"] if i != 1 else []) for i, t in enumerate(TEXTS)], "ord long, text string, snippets array<string>")
    asked = spark.createDataFrame([(1, "box circle")], "query_id long, text string")
    index = bm25.build(docs, F.col("text"), k1=0.0)
    assert index.docs.count() == 3  # document 1 has nothing to insert
    found = bm25.search(index, asked, F.col("text"), 5).orderBy("rank").collect()
    assert [r["ord"] for r in found] == [0, 3, 2]
    assert found[0]["score"] == pytest.approx(np.log(1 + (3 - 2 + 0.5) / 2.5), abs=1e-6)  # k1 = 0: idf alone
    only = bm25.search(index, asked, F.col("text"), 1, known=docs.where("ord >= 2")).collect()
    assert [(r["ord"], r["rank"]) for r in only] == [(3, 1)]


def test_a_models_keys_and_weights(spark, tmp_path):
    (tmp_path / "info.json").write_text(json.dumps({"vocabulary": {"box": 0, "circl": 2, "draw": 1}, "keys": ["b", "gone", "a"]}))
    (tmp_path / "docs.json").write_text(json.dumps({"a": {"comments": ["circle"], "snippets": ["C()"]}, "b": {"comments": ["box"], "snippets": []}}))
    matrix = np.array([[1.0, 0.2, 0.0], [0.5, 0.5, 0.5], [0.0, 0.2, 1.0]])
    engine = jobs.Weighted.create(spark, str(tmp_path / "info.json"), tfidf.weights_score(matrix), str(tmp_path / "docs.json"))
    asked = spark.createDataFrame([(1, "The box, draw!"), (2, "circle circle")], "query_id long, text string")
    found = engine.search(asked, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["ord"], r["rank"]) for r in found] == [(1, "b", 0, 1), (1, "a", 2, 2), (2, "a", 2, 1), (2, "b", 0, 2)]
    assert found[0]["score"] == pytest.approx(1.2 / np.sqrt(2 * 1.04), abs=1e-6)


def test_one_best_chunk_a_document(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "en"), (1, [0.9, 0.1], "en"), (1, [0.8, 0.1], "en"), (2, [0.5, 0.5], "en"), (3, [0.7, 0.0], "de")], "ord long, vec array<float>, lang string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], "en"), (8, [1.0, 0.0], "de")], "query_id long, vec array<float>, lang string")
    by = ["query_id", "rank"]
    wanted = [(7, 1, 1.0, 1), (7, 2, 0.5, 2), (8, 3, 0.7, 1)]
    for found in (dense.search(asked, chunks, 2, ["lang"]), dense.blocked_search(asked, chunks, 2, ["lang"])):
        assert [(r["query_id"], r["ord"], r["score"], r["rank"]) for r in found.orderBy(*by).collect()] == wanted


def test_queries_are_cut_and_documents_are_not(spark):
    long = " ".join(["a"] * 512 + ["b"] * 300)
    one = dense.encode_queries(spark.createDataFrame([(1, long), (2, " ".join(["a"] * 512))], "query_id long, text string"), stub_tokenizer, stub_encoder).collect()
    assert one[0]["vec"] == one[1]["vec"]
    assert len(dense.build_index(spark.createDataFrame([(0, [long])], "ord long, comments array<string>"), stub_tokenizer, stub_encoder).collect()[0]["embeddings"]) == 2


def field(number, kind, value):
    """A protocol buffer field: a varint (kind 0) or bytes (kind 2)."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value)


def tiny_model(table):
    """An ONNX model that looks its input ids up in a table of hidden states."""
    dims = b"".join(field(1, 0, d) for d in table.shape)
    weights = dims + field(2, 0, 1) + field(8, 2, b"table") + field(9, 2, table.astype("<f4").tobytes())
    node = field(1, 2, b"table") + field(1, 2, b"input_ids") + field(2, 2, b"last_hidden_state") + field(4, 2, b"Gather")

    def value(name, kind, *shape):
        sizes = b"".join(field(1, 2, field(2, 2, s.encode()) if isinstance(s, str) else field(1, 0, s)) for s in shape)
        return field(1, 2, name) + field(2, 2, field(1, 2, field(1, 0, kind) + field(2, 2, sizes)))

    graph = field(1, 2, node) + field(2, 2, b"g") + field(5, 2, weights) + field(11, 2, value(b"input_ids", 7, "n", "m")) + field(12, 2, value(b"last_hidden_state", 1, "n", "m", table.shape[1]))
    return field(1, 0, 8) + field(8, 2, field(2, 0, 13)) + field(7, 2, graph)


def test_model_and_tokenizer_files(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = np.random.default_rng(1).normal(size=(5, 6)).astype(np.float32)
    (tmp_path / "tiny.onnx").write_bytes(tiny_model(table))
    words = Tokenizer(models.WordLevel({"[UNK]": 0, "draw": 1, "a": 2, "box": 3, "circle": 4}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "words.json"))
    names = [dense.ship(spark, str(tmp_path / n)) for n in ("tiny.onnx", "words.json")]
    encoder, tokenizer = dense.onnx_encoder(names[0]), dense.file_tokenizer(names[1])
    docs = spark.createDataFrame([(0, "x", ["draw a box"], ["B()"]), (1, "y", ["draw a circle"], []), (2, "z", [], [])], "ord long, id string, comments array<string>, snippets array<string>")
    engine = jobs.Dense(dense.build_index(docs, tokenizer, encoder), tokenizer, encoder)
    mean = table[[1, 2, 3]].mean(0)
    assert engine.index.where("ord = 0").collect()[0]["embeddings"][0] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-5)
    found = engine.search(spark.createDataFrame([(5, "draw a circle")], "query_id long, text string"), 3).orderBy("rank").collect()
    assert [r["id"] for r in found] == ["y", "x", "z"] and found[0]["score"] == pytest.approx(1, abs=1e-5) and found[2]["score"] == float("-inf")
    assert dense.session(str(tmp_path / "tiny.onnx")) is dense.session(str(tmp_path / "tiny.onnx"))


def test_build_search_and_evaluate_several_languages(spark, tmp_path):
    files = {
        "en": {"box": {"comments": ["draw a box"], "snippets": ["Box()"]}, "circle": {"comments": ["draw a circle"], "snippets": ["C()"]}, "7": {"comments": ["seven"], "snippets": ["S()"]}},
        "zh-cn": {"box": {"comments": ["画一个对话框"], "snippets": ["Box()"]}, "circle": {"comments": ["画圆形"], "snippets": ["C()"]}},
    }
    for lang, docs in files.items():
        (tmp_path / f"{lang}.json").write_text(json.dumps(docs, ensure_ascii=False))
    shifted = lambda ids, mask: stub_encoder((ids + 1) % 998, mask)  # noqa: E731  another encoder for the other language
    letters = lambda line: [ord(c) % 997 + 1 for c in line]
    encoders = {"en": (stub_tokenizer, stub_encoder), "zh-cn": (letters, shifted)}
    index = jobs.build_all(spark, {lang: (str(tmp_path / f"{lang}.json"), *own) for lang, own in encoders.items()}, str(tmp_path / "index"))
    assert index.count() == 5 and (tmp_path / "index" / "lang=zh-cn").is_dir()
    assert [r["id"] for r in index.where("lang = 'en'").orderBy("ord").collect()] == ["7", "box", "circle"]  # whole numbers come first
    engines = jobs.load_all(spark, str(tmp_path / "index"), encoders)
    cases = [{"key": "box", "query": "draw a box", "lang": "en"}, {"key": "box", "query": "draw a circle", "lang": "en"}, {"key": "circle", "query": "画圆形", "lang": "zh-cn"}, {"key": "x", "query": "x", "lang": "fr"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases, ensure_ascii=False))
    graded = jobs.run_eval(spark, str(tmp_path / "cases.json"), engines, report=str(tmp_path / "report"))
    assert sorted((r["lang"], r["query"], r["score"]) for r in graded.collect()) == [("en", "draw a box", 1.0), ("en", "draw a circle", 0.5), ("zh-cn", "画圆形", 1.0)]
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0].startswith("TEST RESULTS - ") and lines[1:5] == ["=" * 42, "", "LANGUAGE: EN", "-" * 42]
    assert lines[5:11] == ["Key: box (Avg: 0.7500)", "  - [Score: 1     ] Query: draw a box", "  - [Score: 0.5   ] Query: draw a circle", "", ">> TOTAL AVERAGE FOR EN: 0.7500", "=" * 42]
    asked = source.read_cases(spark, str(tmp_path / "cases.json")).select(F.col("no").alias("query_id"), "lang", F.col("query").alias("text"))
    assert [r["lang"] for r in jobs.unanswered(asked, engines).collect()] == ["fr"]
    tokens = {"en": bm25.lexical_tokens, "zh-cn": segment.chinese_tokens({"对话框": 3.0, "圆形": 2.0, "画": 1.0})}
    lexical = {lang: jobs.Lexical.create(spark, str(tmp_path / f"{lang}.json"), tokenizer=tokens[lang]) for lang in files}
    best = {r["query_id"]: r["id"] for r in jobs.search_all(asked.where("lang <> 'fr'"), lexical, 1).collect()}
    assert best == {0: "box", 1: "circle", 2: "circle"}
    empty = jobs.Dense(index.limit(0), stub_tokenizer, stub_encoder)
    with pytest.raises(ValueError):
        jobs.run_eval(spark, str(tmp_path / "cases.json"), {"en": empty})
    assert empty.search(asked.select("query_id", "text"), 2).count() == 0


def test_segments():
    cut = segment.Segmenter({"系统": 9, "函数": 8, "函数库": 6, "对话框": 5, "研究": 5, "研究生": 4, "生命": 5, "命": 2}).cut
    assert cut("系统函数库中的对话框 Box2 ok!") == ["系统", "函数库", "中", "的", "对话框", " ", "Box2", " ", "ok", "!"]
    assert cut("研究生命") == ["研究", "生命"]
    assert segment.pairs("对话框A圆") == ["对话", "话框", "A", "圆"] and cut("") == segment.pairs("") == []


def test_blank_tokens_go_and_case_stays(spark):
    rows = spark.createDataFrame([(" 圆　Box ",), (None,)], "text string").select(segment.chinese_tokens()(F.col("text")).alias("t"))
    assert [r["t"] for r in rows.collect()] == [["圆", "Box"], []]


def test_other_character_tables(spark):
    row = spark.createDataFrame([("甲乙 丙",)], "text string").select(lang.identify_language(F.col("text"), ("甲", "乙丙")).alias("a"), lang.identify_language(F.col("text"), ("甲丙", "乙")).alias("b"))
    assert tuple(row.collect()[0]) == ("zh-tw", "zh-cn")


def test_dense_plans_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i // 3, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    chunks, asked = spark.createDataFrame(rows, "ord long, vec array<float>"), spark.createDataFrame([(q, rows[q][1]) for q in range(5)], "query_id long, vec array<float>")
    by = ["query_id", "rank"]
    a, b = dense.search(asked, chunks, 4).orderBy(*by).collect(), dense.blocked_search(asked, chunks, 4).orderBy(*by).collect()
    assert [(r["query_id"], r["ord"], r["rank"]) for r in a] == [(r["query_id"], r["ord"], r["rank"]) for r in b]
    assert dense.blocked_search(asked.limit(0), chunks, 4).count() == 0


def test_dense_plans_answer_all_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    rows = [(i // 3, [float(i % 7), float(i % 11), 1.0]) for i in range(60)]
    chunks, asked = spark.createDataFrame(rows, "ord long, vec array<float>"), spark.createDataFrame([(q, rows[q][1]) for q in range(5)], "query_id long, vec array<float>")
    by = ["query_id", "rank"]
    a, b = dense.search(asked, chunks, 4).orderBy(*by).collect(), dense.blocked_search(asked, chunks, 4).orderBy(*by).collect()
    assert [r["query_id"] for r in a] == [q for q in range(5) for _ in range(4)]
    assert [(r["query_id"], r["ord"], r["score"], r["rank"]) for r in a] == [(r["query_id"], r["ord"], r["score"], r["rank"]) for r in b]
    assert dense.search(asked.limit(0), chunks, 4).count() == 0


def test_all_query_vectors_are_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    rows = [(i, [float(i), 1.0], i % 3) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["dot_similarity"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in found} == {(q, i, q * i + 1.0) for q in range(0, 100, 20) for i in range(100)}
    assert len(found) == 500


def test_dense_index_keeps_all_documents(spark):
    docs = spark.createDataFrame([(0, ["draw a box"]), (1, []), (2, ["w " * 600])], "ord long, comments array<string>")
    rows = {r["ord"]: r["embeddings"] for r in dense.build_index(docs, stub_tokenizer, stub_encoder).collect()}
    assert [len(rows[i]) for i in range(3)] == [1, 0, 2]
    asked = dense.encode_queries(spark.createDataFrame([(9, "draw a box")], "query_id long, text string"), stub_tokenizer, stub_encoder)
    best = dense.blocked_search(asked, dense.exploded(dense.build_index(docs, stub_tokenizer, stub_encoder)), 1).collect()[0]
    assert (best["ord"], best["score"]) == (0, 1.0)


def test_evaluation(spark):
    ranked = spark.createDataFrame([(q, o, r) for q in range(2) for o, r in ((10, 1), (11, 2), (12, 6))], "query_id long, ord long, rank int")
    cases = spark.createDataFrame([(0, 10, "en", "a", "x"), (1, 11, "en", "a", "y"), (0, 12, "en", "b", "z"), (1, 99, "en", "b", "w")], "query_id long, expected long, lang string, key string, query string")
    graded = evaluate.grade(cases, ranked)
    assert sorted(r["score"] for r in graded.collect()) == [0.0, 0.0, 0.5, 1.0]
    lines = [r["line"] for r in evaluate.report_lines(graded).orderBy("no").collect()]
    assert lines == [
        "LANGUAGE: EN", "-" * 42, "Key: a (Avg: 0.7500)", "  - [Score: 1     ] Query: x", "  - [Score: 0.5   ] Query: y", "", "Key: b (Avg: 0.0000)",
        "  - [Score: 0     ] Query: w", "  - [Score: 0     ] Query: z", "", ">> TOTAL AVERAGE FOR EN: 0.3750", "=" * 42, "",
    ]
    with pytest.raises(ValueError):
        evaluate.require_index(ranked.limit(0))


def test_macro_mean_is_not_the_micro_mean(spark):
    rows = spark.createDataFrame([("en", "A", 1.0)] * 4 + [("en", "B", 0.0)], "lang string, key string, score double")
    assert evaluate.macro_means(evaluate.key_means(rows)).collect()[0]["total_avg"] == 0.5


@pytest.mark.parametrize(
    ("comments", "snippets", "wanted"),
    [(["c1", "c2"], ["s1"], "c1\n  c2\n  s1"), ([], ["s1"], "\n  s1"), (["c1"], [], "c1"), ([], [], ""), (None, None, "")],
)
def test_insert_text(spark, comments, snippets, wanted):
    row = spark.createDataFrame([(comments, snippets)], "c array<string>, s array<string>")
    assert row.select(assemble.insert_text(F.col("c"), F.col("s"), F.lit("  ")).alias("t")).collect()[0]["t"] == wanted


def test_files_and_completions(spark, tmp_path):
    corpus = {"b": {"comments": ["draws a box", "second"], "snippets": ["Box()"], "key": None}, "a": {"comments": ["draws a circle"], "snippets": []}}
    (tmp_path / "docs.en.json").write_text(json.dumps(corpus))
    (tmp_path / "cases.json").write_text(json.dumps([{"key": "b", "query": "box", "lang": "en"}]))
    (tmp_path / "info.json").write_text(json.dumps({"vocabulary": {"box": 0}, "keys": ["b"]}))
    (tmp_path / "x.SRC").write_text("  { draws a box }\n\n{ }\nplain\n")
    docs = source.read_corpora(spark, {"en": str(tmp_path / "docs.en.json")})
    assert [(r["ord"], r["id"]) for r in docs.orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    assert docs.where(source.has_snippets(F.col("snippets"))).count() == 1
    assert source.read_cases(spark, str(tmp_path / "cases.json")).collect()[0]["query"] == "box"
    vocabulary, keys = source.read_model_info(spark, str(tmp_path / "info.json"))
    assert vocabulary.collect()[0]["idx"] == 0 and keys.collect()[0]["key"] == "b"
    lines = source.line_before(source.read_lines(spark, str(tmp_path / "x.SRC"))).withColumn("character", F.lit(0))

    def search(asked):
        found = bm25.search(bm25.build(docs, F.array_join("comments", " ")), asked, F.col("text"), 1)
        return found.join(asked.select("query_id", "lang"), "query_id")

    items = assemble.completions(lines, docs, search, ["en"]).collect()
    assert [(i["line_no"], i["insert_text"], i["insert_character"], i["remove_from"], i["remove_to"]) for i in items] == [(1, "draws a box\n  second\n  Box()", 1, 1, 3)]
    assert assemble.completions(lines, docs, search, ["zh-cn"]).count() == 0


def test_index_round_trips(spark, tmp_path):
    index = spark.createDataFrame([("en", "a", (["c"], ["s"], None), [[0.1, 0.2], [0.3, 0.4]])], "lang string, id string, doc struct<comments:array<string>,snippets:array<string>,key:string>, embeddings array<array<float>>")
    source.save_index(index, str(tmp_path / "index"))
    source.export_index(index, str(tmp_path / "json"))
    for back in (source.load_index(spark, str(tmp_path / "index")), source.import_index(spark, str(tmp_path / "json"))):
        assert back.collect()[0]["embeddings"] == index.collect()[0]["embeddings"]


def test_report_file(spark, tmp_path):
    source.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "no int, line string"), str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]


def test_serving(spark, index, tmp_path):
    spark.createDataFrame([(1, "draw box")], "query_id long, text string").write.json(str(tmp_path / "in"))
    asked = spark.readStream.schema("query_id long, text string").json(str(tmp_path / "in"))
    serve(asked, lambda q: bm25.search(index, q, F.col("text"), 2), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert {r["ord"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0, 1}


def by_hand(a, b):
    """A dot product as SQL has it, None without one."""
    return None if a is None or b is None or None in (*a, *b) or len(a) != len(b) else sum(float(x) * float(y) for x, y in zip(a, b, strict=True))


ODD_VECTORS = [[0.5, -1.0, 2.0], None, [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 0.0], [2.0**-8, 0.0, 0.0], [0.0, 0.0, 0.0], [float("inf"), 1.0, 1.0]]


def test_pair_scores_are_matrix_products(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dense, "SLICE", 2)
    rows = list(enumerate(ODD_VECTORS))
    chunks, asked = spark.createDataFrame(rows, "no int, vec array<float>").coalesce(1), spark.createDataFrame(rows, "query_id long, vec array<float>")
    found = dense.pair_scores(asked, chunks, "no")
    assert found.dtypes == [("query_id", "bigint"), ("no", "int"), ("score", "double")]
    assert "Join" not in found._jdf.queryExecution().toString()  # pairs are not rows before they are scores
    assert dense.dealt(chunks).rdd.getNumPartitions() > 4  # one file does not make one task
    got = {(r["query_id"], r["no"]): r["score"] for r in found.collect()}
    assert len(got) == len(rows) ** 2
    for q, a in rows:
        for n, b in rows:
            want = by_hand(a, b)
            assert got[q, n] is None if want is None else got[q, n] == pytest.approx(want, abs=6e-7, nan_ok=True), (q, n)
    assert got[5, 5] == 0.000015 and str(got[6, 0]) == "0.0"
    assert dense.pair_scores(asked.limit(0), chunks, "no").count() == 0


def test_best_chunks_are_found_by_matrix_products(spark, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 4)
    rows = [(i % 5, v) for i, v in enumerate(ODD_VECTORS * 2)]
    chunks, asked = spark.createDataFrame(rows, "ord long, vec array<float>"), spark.createDataFrame(list(enumerate(ODD_VECTORS)), "query_id long, vec array<float>")
    found = dense.search(asked, chunks, 4)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    # NaN is the largest, null the smallest, as in SQL.
    order = lambda s: (2, 0.0) if s is not None and s != s else (0, 0.0) if s is None else (1, s)
    for q, a in enumerate(ODD_VECTORS):
        best = {o: max((by_hand(a, b) for n, b in rows if n == o), key=order) for o in range(5)}
        best = {o: s if s is None or s != s else round(s, 6) for o, s in best.items()}
        want = sorted(best, key=lambda o: (-order(best[o])[0], -order(best[o])[1], o))[:4]
        got = sorted((r["rank"], r["ord"], r["score"]) for r in found.where(F.col("query_id") == q).collect())
        assert [o for _, o, _ in got] == want, q
        assert [s for *_, s in got] == pytest.approx([best[o] for o in want], abs=2e-6, nan_ok=True)


def test_report_prints_means_as_sql(spark):
    # Means of 0.03125 (a tie: to even), 0.56875 (below it in binary) and 0.00625 (above it); the total is their mean.
    rows = [("a", s) for s in [0.0625, 0.0]] + [("b", s) for s in [1.0] * 4 + [0.5] * 3 + [0.125, 0.0625, 0.0]] + [("c", s) for s in [0.0625] + [0.0] * 9]
    cases = spark.createDataFrame([("en", key, f"q{i}", s) for i, (key, s) in enumerate(rows)], "lang string, key string, query string, score double")
    lines = [r["line"] for r in evaluate.report_lines(cases).orderBy("no").collect()]
    means = {key: sum(s for k, s in rows if k == key) / sum(k == key for k, _ in rows) for key in "abc"}
    shown = [m for m in lines if m.startswith("Key: ")]
    assert shown == duckdb.sql("SELECT list('Key: ' || k || ' (Avg: ' || printf('%.4f', a) || ')' ORDER BY k) FROM (VALUES " + ", ".join(f"('{k}', {a!r}::DOUBLE)" for k, a in means.items()) + ") v(k, a)").fetchall()[0][0]
    assert shown[0] == "Key: a (Avg: 0.0312)"


ODD_TEXTS = ["", None, "Ünïcode Wörter und İstanbul K", "a1 B2\x00c3", "\ufb01ne x\u00b2 \uff21\uff22", "x" * 40 + " y", "画一个 box", "a  b\n\tc ", "éé é", "ß ẞ ſt ①"]


def test_lexical_tokens_are_the_same_in_python(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "no int, text string").select("no", bm25.lexical_tokens(F.col("text")).alias("t")).orderBy("no").collect()
    assert bm25.lexical_lists(pa.array(ODD_TEXTS)).to_pylist() == [r["t"] for r in rows]
    assert bm25.lexical_lists(pa.array([], pa.string())).to_pylist() == []


def test_scoring_is_bounded_whatever_the_batch(spark, monkeypatch):
    """Slices of tokens and of cells, whatever the rows of a batch, and the same sums."""
    lists = pa.array([["a"] * 5, [], None, ["b"] * 9, ["a", "b"]] * 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), lists], names=["ord", "tokens"])
    monkeypatch.setattr(bm25, "CELLS", 10)
    cut = list(bm25.pieces(batch, 1))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and all(pc.sum(pc.list_value_length(p.column(1))).as_py() <= 19 for p in cut)
    doc, word, tf = bm25.counts_of(lists, pa.array(["a", "b"]))
    first, query, w = np.array([0, 3, 4]), np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 3.0, 4.0])
    parts = list(bm25.sums(100, doc, word, tf.astype(float), first, query, w, 3))
    want = np.zeros((100, 3))
    for d, n, f in zip(doc, word, tf, strict=True):
        for i in range(first[n], first[n + 1]):
            want[d, query[i]] += f * w[i]
    got = np.zeros((100, 3))
    for row, q, s in parts:
        got[row, q] += s
    assert np.allclose(got, want) and len(parts) > 10 and max(len(r) for r, *_ in parts) <= 12


@pytest.mark.parametrize("known_limit", [2, 2_000_000])
def test_known_documents_are_ranked_alone(spark, monkeypatch, known_limit):
    monkeypatch.setattr(bm25, "KNOWN", known_limit)
    docs = spark.createDataFrame([(i, f"draw box {'circle ' * (i % 4)}") for i in range(40)], "ord long, text string")
    asked = spark.createDataFrame([(1, "draw circle"), (2, "nothing")], "query_id long, text string")
    index, known = bm25.build(docs, F.col("text")), docs.where("ord % 3 = 0")
    every = bm25.search(index, asked, F.col("text"), 40).where("ord % 3 = 0").orderBy("query_id", "rank").collect()
    best = bm25.search(index, asked, F.col("text"), 5, known=known).orderBy("query_id", "rank").collect()
    want = [r for q in (1, 2) for r in [e for e in every if e["query_id"] == q][:5]]
    assert [(r["query_id"], r["ord"], r["score"]) for r in best] == [(r["query_id"], r["ord"], r["score"]) for r in want]
    if known_limit > 2:  # what is shuffled is k rows of a task, no row for each pair
        assert "LeftSemi" in bm25.scores(index, bm25.query_tokens(asked, F.col("text")), 5, known.select("ord"))._jdf.queryExecution().toString()


def test_texts_that_hold_queries(spark, monkeypatch):
    monkeypatch.setattr(registry, "_SOUGHT", 3)
    texts = ["the red fox [ran] away.", "a+b", "x\n(y) z|w é ü ß and more of it", "fox", "", "Fox", None, "no \\E such", "画一个圆形的对话框"]
    docs = [t and f"before {t} after" for t in texts] + ["the red fox", "", None, "a+b a+b the red fox [ran] away."]
    rows = spark.createDataFrame(list(enumerate(docs)), "ord long, text string")
    asked = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    found = registry._holding(rows, asked)
    assert found.dtypes == [("item_id", "int"), ("ord", "bigint")]
    assert sorted(map(tuple, found.collect())) == sorted((i, o) for i, t in enumerate(texts) for o, d in enumerate(docs) if t is not None and d is not None and t in d)
    assert "Join" not in found._jdf.queryExecution().toString()  # one pass, no shuffle of texts
    assert registry._holding(rows, asked.limit(0)).count() == 0
