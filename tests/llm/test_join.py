"""The n-gram join against brute force, with every path forced in turn."""

import random

import pytest

from sparklode.llm import components, ngram_join
from sparklode.llm.ngram_join import Rule


def sets(text, rule):
    lower = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in lower).split()
    if len(lower) < rule.words:
        return {tuple(lower)} if lower else set()
    return {tuple(lower[i : i + rule.words]) for i in range(len(lower) - rule.words + 1)}


def brute(rows, rule=Rule()):
    own = [(i, sets(t, rule)) for i, t in rows]
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(own)):
        for y in range(x):
            a, b = own[x][1], own[y][1]
            if a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(own):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)] if s else i) for x, (i, s) in enumerate(own))


def corpus(seed, docs=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [rnd.choice(words) for _ in range(20)]
    out = []
    for i in range(docs):
        kind = rnd.random()
        if kind < 0.45 and out:
            base = rnd.choice(out)[1].split()
            for _ in range(rnd.randrange(4)):
                if base:
                    base[rnd.randrange(len(base))] = rnd.choice(words)
            text = " ".join(base)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 6, 7, 8, 9, 12, 16, 40, 90])))
            if kind > 0.7:
                text += " " + " ".join(shared)
        out.append((i, text))
    return out


@pytest.mark.parametrize(
    ("seed", "changes"),
    [
        (1, {}), (3, {"SALT_AT": 2, "HEAVY": 2, "HOLD": 1}), (4, {"LARGEST_SMALL": 0, "ROUNDS": (1, 2, 1 << 62), "MAX_PLACES": 64}),
        (6, {"CELL": 3, "READ": 5, "PAIRS": 7, "HEAVY": 2, "VERIFY": 1e6}),
    ],
)
def test_components_equal_brute_force(spark, monkeypatch, seed, changes):
    for name, value in changes.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_crowds_that_fall_apart(spark, monkeypatch):
    """Variants of one text whose changes add up: many sets under the same keys, few of which link."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            own[rnd.randrange(60)] = f"x{rnd.randrange(400)}"
        rows.append((i, " ".join(own)))
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    wanted = brute(rows)
    assert sorted(map(tuple, found)) == wanted and 5 < len({c for _, _, c in wanted}) < 80


def test_rows_without_an_id_link_and_rows_of_one_id_are_told_apart(spark):
    words = [f"w{i}" for i in range(40)]
    near = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(words))
    other, third = (" ".join(f"{c}{i}" for i in range(20)) for c in "yz")
    rows = [(1, near(0, 1)), (None, near()), (3, near(38, 39)), (None, other), (None, "one two three"), (7, third), (7, third + " a b c"), (7, other + " tail"), (8, None), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    assert {(1, 36, 1), (None, 36, 1), (3, 36, 1), (None, 1, None), (None, 16, 7), (7, 17, 7), (7, 16, 7), (7, 19, 7), (8, 0, 8), (None, 0, None)} == found
    for _ in range(2):
        kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs.repartition(5)).collect()), key=repr)
        assert (1, near(0, 1)) in kept and (None, "one two three") in kept and (7, other + " tail") in kept
        assert len(kept) == 7 and sum(t in (third, third + " a b c") for _, t in kept) == 1


def test_overlap_rule_is_exact():
    rule = Rule()
    for a in range(1, 40):
        for b in range(1, 40):
            for o in range(min(a, b) + 1):
                assert (o >= rule.overlap(a, b)) == (100 * o >= 75 * (a + b - o))


def test_boundary_follows_the_costs():
    assert ngram_join.boundary(Rule(), 0.0) < ngram_join.boundary(Rule(), 10.0) <= ngram_join.LARGEST_SMALL


def test_every_repeated_shingle_is_counted(spark):
    rows = [(i, f"a{i} b{i} c{i} the very same five words d{i}") for i in range(40)] + [(i, f"a{i} b{i} c{i} the very same five words d{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")  # one of each kind a task
    counted = sorted(r["n"] for r in ngram_join.count_shingles(docs, Rule()).collect())
    assert counted[-1] == 40 and set(counted[:-1]) == {1}


@pytest.mark.parametrize("parts", [1, 4, ngram_join.PARTS])
def test_shingles_are_counted_in_ranges(spark, monkeypatch, parts):
    monkeypatch.setattr(ngram_join, "PARTS", parts)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = {}
    for texts in docs.select("text").rdd.glom().collect():  # once a class and task
        for s in {s.tobytes(): s for s in ngram_join.shingle_sets([(r["text"] or "").encode() for r in texts], Rule())}.values():
            for x in s.view("int64").tolist():
                wanted[x] = wanted.get(x, 0) + 1
    repeated = {x: n for x, n in wanted.items() if n > 1}
    assert 0 < len(repeated) < len(wanted) and max(repeated.values()) > 5  # in more than one task
    found = ngram_join.count_shingles(docs, Rule(), 2).collect()
    assert len(found) == len(repeated) and {r["shingle"]: r["n"] for r in found} == repeated
    assert len(ngram_join.count_shingles(docs, Rule()).collect()) == len(wanted)


def test_lists_of_prefixes():
    rule = Rule()
    assert ngram_join.met_in_lists(100.0, [], rule) == 0
    assert ngram_join.met_in_lists(0.0, [(50.0, 100.0)], rule) == pytest.approx(1)
    assert 0 < ngram_join.met_in_lists(20.0, [(10.0, 80.0)], rule) < 7


def test_sketches_never_overstate():
    import numpy as np

    rng = np.random.default_rng(0)
    for n, m, shared in ((10, 12, 8), (500, 650, 480), (3000, 3000, 0), (5, 5, 5)):
        every = rng.integers(0, 1 << 63, n + m, np.uint64)
        a, b = every[:n], np.concatenate([every[:shared], every[n : n + m - shared]])
        assert ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b)) <= n + m - 2 * shared
        both = ngram_join.Sketches([ngram_join.sketch(a), ngram_join.sketch(b)])
        assert both.differences(np.array([0, 1]), np.array([1, 0])).tolist() == [ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b))] * 2


def test_components_grow_by_further_links(spark):
    edges = lambda *x: spark.createDataFrame(list(x), "a long, b long")
    parts = components.connected(edges((1, 2), (2, 3), (10, 11), (20, 21)))
    same = components.joined(parts, edges((1, 3)))
    assert same is parts
    found = dict(map(tuple, components.joined(parts, edges((3, 11), (30, 21), (40, 41))).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(41), 0), 100: 90, 95: 90, 90: 90}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_tables(odd, crowded, none):
    found = ngram_join.components(crowded).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == by[5] == by[0] == (5, 0) and by[9] == (1, 9) and by[8] == (1, 8)
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: -1 if i is None else i) == [None, 0, 1, 2, 3, 6, 7, 8, 9, 10]
    assert ngram_join.components(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
