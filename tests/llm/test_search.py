"""Decontamination, top-k search, sharding and URL filters against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklode.llm import decontaminate, hilbert_shards, topk_search, url_filters
from sparklode.llm.pretokens import spread


def prose(rnd, n):
    stems = ["ba", "ko", "ri", "su", "te", "lo", "mi", "na", "pe", "du"]
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def leaks(spark):
    rnd = random.Random(3)
    items = [(i, prose(rnd, 30) + ". " + prose(rnd, 8) + ".") for i in range(20)]
    docs = [(i, prose(rnd, 200)) for i in range(200)]
    for i in range(10):  # verbatim, inside other text
        docs[i] = (i, prose(rnd, 50) + " " + items[i][1] + " " + prose(rnd, 60))
    for i in range(10, 15):  # every seventh word replaced, the answer kept
        words = items[i][1].split()
        words = [w if k % 7 or k > 28 else "zzz" for k, w in enumerate(words)]
        docs[i] = (i, prose(rnd, 70) + " " + " ".join(words) + " " + prose(rnd, 30))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_leaks_are_found_and_nothing_else(leaks):
    docs, items = leaks
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(i, i) for i in range(15)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == list(range(15, 200))


def test_items_come_in_blocks(leaks, monkeypatch):
    docs, items = leaks
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert decontaminate.contaminated(docs, items).select("doc_id").distinct().count() == 15


def accepted(doc, item):
    """Whether any stretch of the words of ``doc`` passes for the words of ``item``, the last third its answer."""
    n = len(item)
    reach = n + 2 * max(decontaminate.STEP, n // 4)
    answer = item[-max(1, n // 3) :]
    for s in range(len(doc)):
        stretch = doc[s : s + reach]
        share = decontaminate.common(item, stretch) / n
        if share >= decontaminate.COPY or share >= decontaminate.PARAPHRASE and decontaminate.common(answer, stretch) / len(answer) >= decontaminate.ANSWER:
            return True
    return False


def test_short_and_changed_items_equal_brute_force(spark):
    rnd = random.Random(8)
    items, docs = [], []
    for i in range(48):
        words = prose(rnd, (6, 9, 14, 20, 28, 60)[i % 6]).split()
        if i % 4 == 0:  # repeated words
            words = [words[k % (len(words) // 2)] for k in range(len(words))]
        items.append((i, " ".join(words)))
        for changed in (0, 0.1, 0.2, 0.3, 0.4):
            own = [w if rnd.random() >= changed else prose(rnd, 1) for w in words]
            docs.append((len(docs), " ".join([prose(rnd, rnd.randrange(80)), *own, prose(rnd, rnd.randrange(80))])))
    wanted = {(d, i) for d, text in docs for i, item in items if accepted(text.split(), item.split())}
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*frames).collect()}
    assert len(wanted) > 150
    assert found == wanted


def test_short_items_and_scripts_without_spaces(spark):
    rnd = random.Random(5)
    han = ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(60)) for _ in range(6)]
    items = [(0, "what is it"), (1, han[0][:30] + "。" + han[0][30:45] + "。"), (2, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (3, "一二三"), (4, "…")]
    docs = [
        (0, "What is it?"), (1, "what is it for"), (2, han[1] + "，" + han[0][:45] + han[2]), (3, han[3] + han[4]), (4, han[1][:20] + han[0][:20] + "的" + han[0][21:45] + han[5][:9]),
        (5, "ดี ภาษาไทยไม่มีช่องว่างระหว่างคำ ครับ"), (6, "一二三"), (7, "一二三四"), (8, ""), (9, None),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(0, 0), (2, 1), (4, 1), (5, 2), (6, 3)}


def test_characters_without_spaces_are_words_of_their_own():
    from sparklode.llm.wordhash import Batch

    text = "ab日本x 𠀀y ไท"
    b = Batch([text.encode(), "漢".encode()], decontaminate.WORDS, lower=True, apart=True)
    data = b.data.tobytes()
    assert [data[i:j].decode() for i, j in zip(b.starts, b.ends, strict=True)] == ["ab", "日", "本", "x", "𠀀", "y", "ไ", "ท", "漢"]
    assert b.count.tolist() == [8, 1]


def test_singular_vectors_of_a_low_rank_matrix():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, decontaminate.BUCKETS))
    column, sign = decontaminate.random_columns()
    omega = np.zeros((decontaminate.BUCKETS, decontaminate.RANK))
    omega[np.arange(decontaminate.BUCKETS), column[:-1]] = sign[:-1]
    vectors, values = decontaminate.singular(x.T @ (x @ omega))
    assert values[:5] == pytest.approx(np.linalg.svd(x, compute_uv=False)[:5], rel=1e-2)
    assert np.linalg.norm(x @ vectors[:, :5]) == pytest.approx(np.linalg.norm(x), rel=1e-3)


def test_common_subsequence():
    rnd = random.Random(5)
    for _ in range(50):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common(a, b) == best[-1][-1]


def test_odd_tables_hold_no_leaks(spark, odd, crowded, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (3, "The quick brown fox jumps over the lazy dog.")], "item_id long, text string")
    found = decontaminate.contaminated(crowded, items).collect()
    assert {r["doc_id"] for r in found} == {0, 4, 5}
    assert decontaminate.clean(crowded, items).columns == crowded.columns
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(odd, items.limit(0)).count() == 0


def brute_search(rows, k):
    tok = [(i, Counter(re.findall(rb"[A-Za-z0-9\x80-\xff]+", (t or "").encode().lower()))) for i, t in rows]
    n, df, dl = len(tok), Counter(w for _, c in tok for w in c), [sum(c.values()) for _, c in tok]
    mean, out = sum(dl) / n, {}
    for q, asked in tok:
        if q % 50:
            continue
        scores = []
        for (i, c), length in zip(tok, dl, strict=True):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in asked if w in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("changes", [{}, {"SHARD": 40, "BLOCK": 4, "QUERY_TERMS": 300, "FIRST": 1, "WIDTH": 2, "FREQUENT": 8, "COLUMNS": 5, "TOGETHER": 3}])
def test_top_k_equals_brute_force(spark, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(topk_search, name, value)
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.choice([0, 3, 40, 150]))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for r in topk_search.search(docs, docs.where("doc_id % 50 = 0"), 7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    wanted = {q: x for q, x in brute_search(rows, 7).items() if x}
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in wanted.items()}
    for q, x in wanted.items():
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in x])


def test_pivots_skip_blocks(monkeypatch):
    """A shard of which one block can win is not evaluated elsewhere, and gives what evaluating all gives."""
    rng = np.random.default_rng(2)
    docs, words = 640, 30
    tf = rng.poisson(np.linspace(0.3, 0.01, words)[:, None], (words, docs))
    tf[:, 320:330] += 9
    word, doc = np.nonzero(tf)
    row = [np.arange(docs), np.full(docs, 40), np.arange(words).astype(np.uint64), np.append(0, np.cumsum(np.bincount(word, minlength=words))), doc.astype(np.uint16), tf[word, doc].astype(np.uint32)]
    shard = topk_search.Shard([x.tobytes() for x in row], 40.0)
    assert 0 < len(shard.columns) < words  # some words are frequent, some are not
    asked = [(np.arange(words), np.linspace(3, 1, words)), (np.arange(0, words, 3), np.ones(10)), (np.arange(words - 1, words), np.ones(1))]
    best = topk_search.Best(np.array([7, 8, 9]), 5)
    read = []
    monkeypatch.setattr(topk_search, "spread", lambda starts, sizes: read.append(int(sizes.sum())) or spread(starts, sizes))
    shard.search(np.repeat(np.arange(3), [len(w) for w, _ in asked]), np.concatenate([w for w, _ in asked]), np.concatenate([x for _, x in asked]), best)
    part = tf * 2.2 / (tf + 1.2)
    for q, (word, weight) in enumerate(asked):
        scores = np.round(weight @ part[word], 6)
        every = np.lexsort((np.arange(docs), -scores))[:5]
        every = every[scores[every] > 0]
        assert best.doc[best.query == q].tolist() == every.tolist() and best.score[best.query == q] == pytest.approx(scores[every], abs=1e-9)
    postings = sum(shard.run_size[shard.entry[x] : shard.entry[x + 1]].sum() for w, _ in asked for x in w)
    assert 0 < sum(read[1:]) < postings  # the first reads entries, the others the postings of evaluated blocks


def test_top_k_equals_sql(spark):
    import duckdb

    rows = [(i, t) for i, t in enumerate(["Ünder the Bridge", "the bridge", None, "", "a b c", "the the the"] * 30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas()  # noqa: F841
    wanted = duckdb.sql(topk_search.ORACLE_SQL).df().sort_values(["query_id", "rank"]).to_numpy().tolist()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = topk_search.search(docs, docs.where("doc_id % 50 = 0"), 10).orderBy("query_id", "rank").collect()
    assert [list(map(float, r)) for r in found] == wanted


def test_searching_odd_tables(crowded, none):
    found = topk_search.search(crowded, crowded.where("doc_id IN (0, 1, 9)"), 3)
    assert [(r["query_id"], r["doc_id"]) for r in found.orderBy("query_id", "rank").collect()] == [(0, 0), (0, 4), (0, 5), (9, 9), (9, 9)]
    assert topk_search.search(none, none, 3).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert_shards.hilbert_index(points, bits)
    assert sorted(index) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards(spark, odd, crowded, none, tmp_path):
    rows = hilbert_shards.assign(crowded, 4).collect()
    assert len(rows) == odd.count()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(4))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert hilbert_shards.assign(none).count() == 0
    hilbert_shards.write_shards(odd, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [4, 4, 5]
    assert sorted(r["text"] or "" for r in back.collect()) == sorted(r["text"] or "" for r in odd.collect())


def test_shards_prune_on_every_dimension_and_keep_equal_texts_together(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, rnd.choice([5, 40, 300])), rnd.choice("abcd"), f"s{rnd.randrange(30):02}") for i in range(1500)]
    rows += [(1500 + i, rows[7][1], rnd.choice("abcd"), f"s{i % 30:02}") for i in range(60)] + [(1600, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = hilbert_shards.assign(docs, 40).drop("size").join(docs.select("doc_id", "lang", "source", F.length("text").alias("size")), "doc_id")
    spans = found.groupBy("shard").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source", "size") for f in (F.min, F.max)]).collect()
    # Shares of files that statistics leave to be read for one value; rows in no order leave nearly all.
    for column, value, most in (("lang", "b", 0.7), ("source", "s11", 0.5), ("size", 15, 0.7)):
        read = sum(r[f"min_{column}"] is not None and r[f"min_{column}"] <= value <= r[f"max_{column}"] for r in spans) / 40
        assert 0 < read <= most, (column, read)
    copies = sorted((r["shard"], r["slot"]) for r in found.join(docs.where(F.col("text") == rows[7][1]).select("doc_id"), "doc_id").collect())
    assert len(copies) == 61 and len({s for s, _ in copies}) <= 3
    for s in {s for s, _ in copies}:
        slots = [k for t, k in copies if t == s]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
    full = (r["min_source"] for r in spans)
    assert hilbert_shards.bounds(docs, "source")[0] == ("s00", 1) and len(set(full)) > 5


def test_written_shards_replace_a_column_of_that_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "en", "s", "own", 5) for i in range(9)], "doc_id long, text string, lang string, source string, shard string, `a.b` int")
    hilbert_shards.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 9 and sorted(back.columns) == sorted(docs.columns) and {r["shard"] for r in back.collect()} == {0, 1, 2}


def test_url_rules(spark):
    urls = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("http://net/", "net", "/", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"),
        ("https://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
        ("https://example.com/de/?a", "example.com", "/de/", "example.com/de/", "block"), ("https://example.com/de", "example.com", "/de", None, "allow"),
        ("x://a.org/fr/#f", "a.org", "/fr/", "org/fr/", "allow"), ("x://a.org/FR/", "a.org", "/FR/", None, "allow"), ("http://m.casino-win.example.com/en/", "m.casino-win.example.com", "/en/", None, "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?q=://net/", "", "", None, "allow"), ("a://b://net/", "b:", "//net/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] + [(None, "http://a.net/x"), (0, "http://a.NET/x")], "page_id long, url string")
    pages = pages.withColumn("rule", F.lit("clash")).withColumn("token", F.lit(1)).withColumn("name", F.lit(2)).withColumn("regex", F.lit(3)).withColumn("tokens", F.lit(4))
    found = url_filters.judge_urls(pages).collect()
    assert len(found) == len(urls) + 2
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert [by[i] for i in range(len(urls))] == [u[1:] for u in urls]
    assert by[None] == by[0]
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_rules_fetch_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://common.org/{i}") for i in range(50)] + [(99, "http://rare.common.org/")], "page_id long, url string")
    rules = (url_filters.host_rule("rare.common.org", "/", "block"), url_filters.Rule("9/$", "block"))
    found = {r["page_id"]: r for r in url_filters.judge_urls(pages, rules).collect()}
    assert found[99]["rule"] == "rare.common.org/" and found[99]["n_candidates"] == 2
    assert found[1]["n_candidates"] == 1 and found[1]["verdict"] == "allow"


@pytest.mark.parametrize("most", [url_filters.MAX_BROADCAST_RULES, 10])
def test_a_table_of_rules_equals_running_all(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MAX_BROADCAST_RULES", most)
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(150)]
    rules = []
    for i in range(300):
        a, b, c = rnd.sample(words, 3)
        regex, branches = rnd.choice([
            (rf"^(?:[^/]*\.)?{a}-{b}\.", [[a, b]]), (rf"/(?:{a}|{b})/", [[a], [b]]), (rf"{a}\.(?:{b}|{c})$", [[a, b], [a, c]]), (rf"^{a}\.[^/]*/.*{b}[0-9]*$", [[a]]),
        ])
        rules.append((i, regex, rnd.choice(["block", "allow"]), None, branches))
    urls = [f"https://{'.'.join(rnd.choice(words) + rnd.choice(['', '-' + rnd.choice(words)]) for _ in range(2))}.org/{'/'.join(rnd.choice(words) for _ in range(3))}{rnd.choice(['', '/', '.' + rnd.choice(words), '7'])}" for _ in range(300)]
    urls += [None, "", "x", "http://a.net/" + "long/" * 20_000 + "adserver/x"] + urls[:5]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "rule_no long, regex string, action string, name string, branches array<array<string>>")
    found = {r["page_id"]: r for r in url_filters.judge_urls(pages, table).collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        target = (url or "").partition("://")[2]
        assert found[i]["verdict"] == ("block" if any(a == "block" and re.search(x, target) for _, x, a, _, _ in rules) else "allow"), url
    assert 0 < sum(r["n_candidates"] for r in found.values()) < len(rules) * len(urls) / 10
    assert url_filters.judge_urls(pages, table.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)


def test_own_patterns_and_blank_urls(spark):
    urls = {"http://x.poker-bonus.org/": "block", "http://poker.org/": "allow", "http://cheap-meds24.org/a": "block", "http://ad-tracker.com": "block", "http://a.org/x/login.php": "block",
            "http://a.org/logins": "allow", "http://a.org/f/setup.exe": "block", "http://a.org/banners/1.gif": "block", "http://banners/1.gif": "allow", None: "allow"}
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(1000 + k, None) for k in range(200)], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages).collect()}
    assert [found[k] for k in range(len(urls))] == list(urls.values()) and len(found) == len(urls) + 200
    # A rule without tokens may block the empty text, in every row of it.
    every = url_filters.judge_urls(pages, (url_filters.Rule("^$", "block"),))
    assert every.where("verdict = 'block'").count() == 201


def test_a_shard_below_the_carried_score_evaluates_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i % 7} w{i % 11} w{i}") for i in range(200)], "doc_id long, text string")
    row = topk_search.build_index(docs.coalesce(1)).collect()[0]
    shard = topk_search.Shard([bytes(x) for x in row], 4.0)
    query, word, weight = np.zeros(3, np.int64), np.arange(3), np.ones(3)
    calls = []
    monkeypatch.setattr(topk_search, "spread", lambda *a, f=topk_search.spread: calls.append(1) or f(*a))
    best = topk_search.Best(np.array([0]), 10)
    shard.search(query, word, weight, best)
    found, evaluated = len(best.doc), len(calls)
    calls.clear()
    best.least[:] = 100.0
    shard.search(query, word, weight, best)
    assert found and evaluated > 1 and len(calls) == 1  # the bounds alone


def test_queries_of_a_word_go_together():
    import pandas as pd

    rows = pd.DataFrame([(q, t, w) for q in range(6) for t, w in ((q % 2, 0.5), (10 + q, 3.0))], columns=["query_id", "term", "w"])
    ids, first, words, at, w = topk_search.packed(rows.sample(frac=1, random_state=1))
    assert ids.tolist() == [0, 2, 4, 1, 3, 5] and first.tolist() == [0, 2, 4, 6, 8, 10, 12]
    for i, q in enumerate(ids.tolist()):
        own = slice(first[i], first[i + 1])
        assert words[at[own]].tolist() == [q % 2, 10 + q] and w[own].tolist() == [0.5, 3.0]


def test_frequent_words_are_summed_in_double_precision(monkeypatch):
    """Scores whose difference single precision cannot tell keep their order, and few documents are summed."""
    monkeypatch.setattr(topk_search, "SUMMED", 50)
    docs, words = 400, 20
    rng = np.random.default_rng(4)
    tf = rng.integers(1, 4, (words, docs))
    row = [np.arange(docs), np.full(docs, 40), np.arange(words).astype(np.uint64), np.arange(words + 1) * docs, np.tile(np.arange(docs), words).astype(np.uint16), tf.ravel().astype(np.uint32)]
    shard = topk_search.Shard([x.tobytes() for x in row], 40.0)
    assert len(shard.columns) == words and shard.columns.dtype == np.float32
    weight = 1000 + rng.integers(0, 9, words) * 1e-5
    best, summed = topk_search.Best(np.array([3]), 10), []
    monkeypatch.setattr(shard, "exactly", lambda w, q, d, f=shard.exactly: summed.append(len(d)) or f(w, q, d))
    shard.search(np.zeros(words, np.int64), np.arange(words), weight, best)
    scores = np.round(weight @ (tf * 2.2 / (tf + 1.2)), 6)
    every = np.lexsort((np.arange(docs), -scores))[:10]
    assert best.doc.tolist() == every.tolist() and best.score == pytest.approx(scores[every], abs=2e-6)
    assert 10 <= sum(summed) < docs
