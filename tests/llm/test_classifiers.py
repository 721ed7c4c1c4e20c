"""Quality, toxicity and language: held-out accuracy on the test tables, odd tables."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.llm import language_id, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def held_out_rows(spark, found, label):
    return found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", label).toPandas()


@tables
def test_quality_on_held_out_rows(spark):
    rows = held_out_rows(spark, queries.op3_quality(spark, SF), "quality")
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


@tables
def test_toxicity_on_held_out_rows(spark):
    rows = held_out_rows(spark, queries.op4_toxicity(spark, SF), "toxic")
    assert rows.loc[rows["toxic"] == 1, "predicted"].mean() >= 0.9
    assert rows.loc[rows["toxic"] == 0, "predicted"].mean() < 0.02


@tables
def test_language_on_held_out_rows(spark):
    found = queries.op7_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).collect()[0][0] > 0.97


def test_held_out_rows_teach_nothing(spark, odd):
    """Labels of held-out rows can be turned around without any effect."""
    rows = odd.where("doc_id IS NOT NULL")
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.labelled(rows, x, "toxic", 100).select("doc_id", "toxic").collect() for x in (labels, turned))
    assert sorted(a) == sorted(b) and len(a)


@pytest.mark.parametrize("some", [True, False])
def test_odd_tables(odd, crowded, none, labels, no_labels, some):
    given = labels if some else no_labels
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(crowded, given, label)
        found = module.score(crowded, model).collect()
        assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
        assert module.score(none, model).count() == 0
        kept = module.keep(crowded, model)
        assert kept.columns == crowded.columns
        wanted = 1 if module is quality else 0
        assert kept.count() == sum(r["predicted"] == wanted for r in found)
    assert module.fit(none, no_labels, label) is not None


def test_language_of_odd_tables(odd, crowded, none):
    net = language_id.fit(crowded)
    found = {r["doc_id"]: r for r in language_id.identify(crowded, net).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert found[0]["lang_pred"] in net.languages
    assert language_id.fit(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_network_slopes_match_differences():
    """The two-layer network's loss falls, and the convolution's paired tables equal plain sums."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    layers = quality.train(x, y, np.ones(400), rounds=30)
    p = np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]
    assert ((p > 0) == y).mean() > 0.97
    data = rng.integers(0, 256, (4, language_id.WINDOW), np.uint8)
    net = language_id.train(data, np.array([0, 1, 0, 1]), ["a", "b"], rounds=1)
    plain = []
    for t, w in zip(net.tables(), language_id.WIDTHS, strict=True):
        n = language_id.WINDOW - w + 1
        plain.append(sum(t[j][data[:, j : j + n]] for j in range(w)).max(1))
    assert np.allclose(language_id.pool(net.paired(), data), np.hstack(plain), atol=1e-4)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(size=5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.temperature_of(3 * z, y, np.ones(5000)) == pytest.approx(3, rel=0.2)


def test_kneser_ney_terms_sum_to_one():
    words = [b"abc", b"abd", b"bcd", b"xyz"]
    b = toxicity.Batch(words, toxicity.LETTERS, True)
    gram = np.unique(toxicity.grams(b.starts, b.ends, b.data)[0])
    contexts, owner = np.unique(gram >> 8, return_inverse=True)
    own, weight = toxicity._class_terms(gram, np.ones(len(gram)), contexts, owner)
    assert np.bincount(owner, weights=own) + weight == pytest.approx(np.ones(len(contexts)))


def test_long_words_are_read_whole(spark):
    good, bad = "好" * 16, "坏" * 16
    rows = spark.createDataFrame([(good + bad, 0), (bad + "x", 1)], "text string, toxic int")
    found = {bytes(r["word"]).decode(): (r["ordinary"], r["toxic"]) for r in toxicity.count_words(rows, "toxic").collect()}
    assert found == {good: (1, 0), bad: (1, 1), "x": (0, 1)}
    model = toxicity.fit_counts([good.encode(), bad.encode()], np.array([50, 1]), np.array([1, 50]))
    a, b, c = toxicity.differences(model, [t.encode() for t in (good + good, good + bad, good + " " + bad)])
    assert a != b and b == pytest.approx(c)


def plain_ratio(words, ordinary, toxic, asked):
    """log P(word | toxic) - log P(word | ordinary), from the definitions, over dictionaries."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    pad = lambda w: b"\0" * (n - 1) + w + b"\0"
    spelled = lambda w: [pad(w)[i : i + n] for i in range(len(w) + 1)]
    every = {g for w in words for g in spelled(w)}

    def shared(g):  # continuation probability of the last byte after the shorter context
        kinds = Counter(x[1:] for x in (every if len(g) == n - 1 else {y[n - len(g) - 1 :] for y in every}))
        if len(g) == 1:
            return kinds[g] / sum(kinds.values())
        total = sum(c for x, c in kinds.items() if x[:-1] == g[:-1])
        follow = sum(1 for x in kinds if x[:-1] == g[:-1])
        if not total:
            return shared(g[1:])
        return max(kinds[g] - d, 0) / total + d * follow / total * shared(g[1:])

    def log_share(w, count):
        counts = Counter()
        for x, c in zip(words, count, strict=True):
            for g in spelled(x):
                counts[g] += c
        spell = 1.0
        for g in spelled(w):
            total = sum(c for x, c in counts.items() if x[:-1] == g[:-1])
            follow = sum(1 for x, c in counts.items() if x[:-1] == g[:-1] and c)
            back = shared(g[1:])
            spell *= max(counts[g] - d, 0) / total + d * follow / total * back if total else back
        every_word = sum(count)
        own = dict(zip(words, count, strict=True)).get(w, 0)
        return math.log(max(own - d, 0) / every_word + d * sum(1 for c in count if c) / every_word * spell)

    return [log_share(w, toxic) - log_share(w, ordinary) for w in asked]


def test_word_ratios_equal_plain_kneser_ney():
    words = [b"trash", b"trap", b"the", b"then", b"scum", b"sun"]
    ordinary, toxic = [0, 5, 40, 9, 0, 7], [6, 1, 30, 4, 5, 1]
    model = toxicity.fit_counts(words, np.array(ordinary), np.array(toxic))
    asked = [*words, b"thrash", b"tres"]  # unseen words, of seen pieces
    b = toxicity.Words([b" ".join(asked)])
    said, back = model.of_words(b)
    wanted = plain_ratio(words, ordinary, toxic, asked)
    assert said[back][: len(words)] == pytest.approx(wanted[: len(words)], abs=1e-4)
    # Of an unseen word only the pieces that a class has seen tell; the backoff is shared.
    assert said[back][len(words) :] == pytest.approx(wanted[len(words) :], abs=0.05)


def test_sums_of_matrices_in_a_tree(spark):
    rng = np.random.default_rng(3)
    parts = [(int(s), rng.integers(0, 1 << 40, 6).astype(float)) for s in range(4) for _ in range(9)]
    rows = spark.createDataFrame([(s, bytearray(x.tobytes())) for s, x in parts], "slice int, cells binary").repartition(9)
    found = quality.sum_matrices(rows, 8, 3, 4)
    assert (found == np.concatenate([sum(x for t, x in parts if t == s).reshape(2, 3) for s in range(4)])).all()


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS", 40)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i % 10)} " * 60, f"l{i % 10}" if i % 3 else "hot") for i in range(600)]
    found = language_id.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    each = found.groupby("lang").size()
    assert len(each) == 11 and each.max() <= language_id.LEAST * language_id.PER_TEXT and each.min() >= language_id.LEAST


def test_thresholds_leave_the_least_hashes(spark):
    from sparklode.llm.common import least_hashes

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    few = least_hashes(rows, "doc_id", 100, F.lit(20_000.0))
    order = lambda df: [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    assert few.count() < 400 and order(few) == order(rows)


def test_toxicity_learns_from_as_many_rows_as_quality():
    assert toxicity.SAMPLE == quality.SAMPLE == 6000


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('word', char(97 + id % 7)) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    read = []
    for name in ("count_words", "difference_rows"):
        monkeypatch.setattr(toxicity, name, lambda rows, *a, f=getattr(toxicity, name): read.append(rows.count()) or f(rows, *a))
    model = toxicity.fit(docs, labels)
    wanted = labels.where(~toxicity.held_out(5, 0)).count()
    assert sum(read) == wanted > 2 * toxicity.SAMPLE
    read.clear()
    monkeypatch.setattr(toxicity, "LABELS", 6000)
    again = toxicity.fit(docs, labels)
    assert len(read) == 6 and sum(read) == wanted
    assert (again.ratio == model.ratio).all() and (again.scale, again.offset) == (model.scale, model.offset)


def test_words_left_out_of_the_model_change_no_score(spark):
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 103, rng.integers(1, 9)).astype(np.uint8)) for _ in range(3000)})
    ordinary, toxic = rng.poisson(3, len(words)), rng.poisson(0.3, len(words))
    table = [(bytearray(w), int(o), int(t)) for w, o, t in zip(words, ordinary, toxic, strict=True)]
    few, _ = toxicity.fit_words(spark.createDataFrame(table, "word binary, ordinary long, toxic long"))
    whole = toxicity.fit_counts(words, ordinary, toxic)
    texts = [b" ".join(words[i] for i in rng.integers(0, len(words), 40)) + b" " + bytes(rng.integers(97, 103, 7).astype(np.uint8)) for _ in range(300)]
    found = toxicity.differences(few, texts)
    assert 0 < len(few.words) < len(whole.words) and found.any()
    assert (found == toxicity.differences(whole, texts)).all()
