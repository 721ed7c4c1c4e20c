"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of ``WINDOW`` words. Document frequencies of hashed
   words cover every passage of every document.
2. Randomised SVD of the TF-IDF passage matrix X in one distributed pass: with
   a fixed sparse random Omega (one signed column for each bucket), the
   partitions add up Z = X'X Omega; the Nystroem form of X'X from Z and Omega
   gives the right singular vectors and values.
3. All passages and the benchmark's are projected on the singular vectors,
   scaled towards equal weight; pairs with a cosine of ``COSINE`` or more are
   candidates. So is every stretch with enough words of an item to be accepted:
   of the words that step 4 needs, those that remain without the item's most
   frequent words, ``LIGHT`` of them at least, must stand within one stretch.
   This misses no pair that step 4 accepts, however short or changed.
4. A candidate is settled on words: the longest common subsequence of the whole
   item and a stretch of the document (the item's length, and a quarter of it
   or ``STEP`` words more at either end) must hold ``COPY`` of the item, or
   ``PARAPHRASE`` of it and ``ANSWER`` of the item's answer (its last sentence,
   or the last third where it has only one). The best stretch is reported, with
   the highest cosine of the passages in it.

The benchmark is a stated query set: it is read in blocks of ``ITEMS`` items, and
each block meets every document. Nothing grows with the corpus on the driver:
the summed matrices have a fixed size.

Words are runs of letters and digits; of scripts written without spaces each
character is one. Items under ``LEAST`` words say too little to be looked for in
other text: they match texts that have their words and no others.

Edge cases: null and empty texts and items without words match nothing; texts
of any length are read whole; an empty benchmark or table gives an empty result;
repeated items are found under each id, repeated documents each; of stretches
with equal shares of an item the first is reported; columns beyond doc_id and
text (item_id and text of the benchmark) are passed through by ``clean`` and
ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows
from .quality import sliced, sum_matrices
from .wordhash import KINDS, Batch, blocks

WINDOW, STEP = 24, 12
BUCKETS, RANK, SLICES = 1 << 13, 128, 16
COSINE = 0.6
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
LEAST = 6
ITEMS = 2000
#: Share of the words needed of an item that the search by words looks for, rare ones first.
LIGHT = 0.35
#: Places of item words that are sorted at once.
PLACES = 4_000_000
#: Singular directions are divided by this power of their values, so that rare words count.
WHITEN = 1.0

WORDS = np.where((KINDS == 1) | (KINDS == 2), 1, 0).astype(np.uint8)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)


def grid(b: Batch, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text in rows of ``width``, the last one filled up with BUCKETS: (rows, text of each, first word of each)."""
    n = -(-b.count // width)
    text = np.repeat(np.arange(len(n)), n)
    start = b.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * width
    at = start[:, None] + np.arange(width)
    inside = at < (b.first + b.count)[text][:, None]
    return np.where(inside, np.append(bucket, np.int32(BUCKETS))[np.minimum(at, len(bucket))], np.int32(BUCKETS)), text, start


def count_passages(texts: list[bytes]) -> np.ndarray:
    """In how many passages (end to end) each bucket stands; cell BUCKETS counts passages."""
    b = Batch(texts, WORDS, lower=True, apart=True)
    rows = np.sort(grid(b, bucket_of(b.hashes), WINDOW)[0].astype(np.uint16), axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    out = np.bincount(rows[new], minlength=BUCKETS + SLICES).astype(np.float64)
    out[BUCKETS] = len(rows)
    return out


def frequencies(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + SLICES)
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                total += count_passages(part)
        if total.any():
            yield sliced(total, SLICES)

    n = sum_matrices(docs.select("text").mapInArrow(run, "slice int, cells binary"), BUCKETS + SLICES, 1, SLICES)[:, 0]
    return np.log((1 + n[BUCKETS]) / (1 + n[:BUCKETS])) + 0.1


def random_columns() -> tuple[np.ndarray, np.ndarray]:
    """Omega: the column and sign of each bucket (of no weight for the filling)."""
    rng = np.random.default_rng(5)
    return rng.integers(0, RANK, BUCKETS + 1).astype(np.int32), rng.choice([-1.0, 1.0], BUCKETS + 1)


def sketch(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """X'X omega over passages end to end: each word adds its passage's words to their columns."""
    b = Batch(texts, WORDS, lower=True, apart=True)
    rows = grid(b, bucket_of(b.hashes), WINDOW)[0]
    column, sign = random_columns()
    weight = np.append(idf, 0.0)
    cell, own = rows * np.int32(RANK), weight[rows]
    col, signed = column[rows], own * sign[rows]
    out = np.zeros((BUCKETS + 1) * RANK)
    for turn in range(WINDOW):
        beside = np.roll(col, turn, axis=1)
        out += np.bincount((cell + beside).ravel(), weights=(own * np.roll(signed, turn, axis=1)).ravel(), minlength=len(out))
    return out.reshape(BUCKETS + 1, RANK)[:BUCKETS]


def latent(table: np.ndarray, b: Batch, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit latent vectors of windows of two rows of STEP words each: (vectors, text, first word)."""
    rows, text, start = grid(b, bucket, STEP)
    half = np.empty((len(rows), RANK), np.float32)
    for at in range(0, len(rows), 512):
        np.add.reduce(table[rows[at : at + 512]], axis=1, out=half[at : at + 512])
    follows = np.append(text[1:] == text[:-1], False)
    both = half.copy()
    both[follows] += half[1:][follows[:-1]]
    alone = ~follows & (np.bincount(text, minlength=len(b.count))[text] > 1)  # a last row stands in the window before
    keep = ~alone
    x = both[keep]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), text[keep], start[keep]


def singular(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of X from X'X omega."""
    column, sign = random_columns()
    omega = np.zeros(z.shape)
    omega[np.arange(BUCKETS), column[:BUCKETS]] = sign[:BUCKETS]
    z = z.astype(float)
    shift = 1e-6 * np.linalg.norm(z) + 1e-12
    z = z + shift * omega
    gram = omega.T @ z
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-12)))
    u, s, _ = np.linalg.svd(z @ root, full_matrices=False)
    return u, np.sqrt(np.maximum(s * s - shift, 0))


def latent_space(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table that takes a bucket to its share of a passage's latent vector, and the buckets' inverse document frequencies."""
    idf = frequencies(docs)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, RANK))
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                total += sketch(part, shared.value)
        if total.any():
            yield sliced(total, SLICES)

    z = sum_matrices(docs.select("text").mapInArrow(run, "slice int, cells binary"), BUCKETS, RANK, SLICES)
    return space_of(idf, z), idf


def space_of(idf: np.ndarray, z: np.ndarray) -> np.ndarray:
    vectors, values = singular(z)
    table = idf[:, None] * vectors * np.maximum(values, 1e-3 * max(values.max(), 1e-12)) ** -WHITEN
    return np.vstack([table, np.zeros((1, RANK))]).astype(np.float32)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of it as the bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items: word hashes, answers, latent windows with the item of each, and light words.

    ``need`` words of an item must be held by a stretch of ``reach`` words, ``must`` of
    them light; ``light`` are the light words of all items, ``word`` and ``holder`` pair
    them with their items.
    """

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    wanted: list[set[int]]
    windows: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    need: np.ndarray
    reach: np.ndarray
    must: np.ndarray
    light: np.ndarray
    word: np.ndarray
    holder: np.ndarray
    short: dict[bytes, list[int]]


def slack_of(n: int) -> int:
    return max(STEP, n // 4)


def light_words(words: list[int], need: int, idf: np.ndarray) -> tuple[list[int], int]:
    """The words left without the most frequent ones, and how many of ``need`` common words must be of them."""
    counts = Counter(words)
    spare = need - max(1, math.ceil(LIGHT * need))
    kept, left = [], spare
    for w in sorted(counts, key=lambda w: (idf[w % BUCKETS], w)):
        if counts[w] <= left:
            left -= counts[w]
        else:
            kept.append(w)
    return kept, need - (spare - left)


def prepare(ids: list, texts: list[bytes], table: np.ndarray, idf: np.ndarray) -> Items:
    b = Batch(texts, WORDS, lower=True, apart=True)
    h = b.hashes
    words, answers = [], []
    for text, f, c in zip(texts, b.first, b.count, strict=True):
        own = h[f : f + c].tolist()
        words.append(own)
        sentences = [s for s in text.replace(b"?", b".").replace(b"!", b".").split(b".") if s.strip()]
        n = int(Batch([sentences[-1]], WORDS, lower=True, apart=True).count[0]) if len(sentences) > 1 else 0
        answers.append(own[-n:] if n else own[-max(1, len(own) // 3) :])
    x, owner, start = latent(table, b, bucket_of(h))
    long = b.count[owner] >= LEAST
    need = [next((c for c in range(len(w)) if c / len(w) >= PARAPHRASE), len(w)) for w in words]
    reach = [len(w) + 2 * slack_of(len(w)) for w in words]
    kept = [light_words(w, n, idf) if len(w) >= LEAST else ([], 1) for w, n in zip(words, need, strict=True)]
    light, word = np.unique(np.array([w for own, _ in kept for w in own], np.uint64), return_inverse=True)
    holder = np.repeat(np.arange(len(kept)), [len(own) for own, _ in kept])
    must = np.array([m for _, m in kept])
    short: dict[bytes, list[int]] = {}
    for i, (f, c) in enumerate(zip(b.first, b.count, strict=True)):
        if 0 < c < LEAST:
            short.setdefault(h[f : f + c].tobytes(), []).append(i)
    return Items(ids, words, answers, [set(w) for w in words], x[long], owner[long], (start - b.first[owner])[long], np.array(need), np.array(reach), must, light, word, holder, short)


def crowded(b: Batch, h: np.ndarray, items: Items) -> Iterator[np.ndarray]:
    """(text, item, first word, end) of the surroundings of all stretches with as many light words of an item as it must have."""
    ends = b.first + b.count
    at = np.minimum(np.searchsorted(items.light, h), len(items.light) - 1)
    held = np.flatnonzero(items.light[at] == h)
    by = held[np.argsort(at[held], kind="stable")]
    times = np.bincount(at[held], minlength=len(items.light))
    first = np.cumsum(times) - times
    # An item's places are at most the words; as many items at once as keep to PLACES.
    turn = np.cumsum(np.bincount(items.holder, weights=times[items.word], minlength=len(items.ids))) // PLACES
    for k in np.unique(turn):
        own = turn[items.holder] == k
        word, holder = items.word[own], items.holder[own]
        n = times[word]
        place = by[np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key = np.sort(np.repeat(holder, n) * len(h) + place)
        item, place = key // len(h), key % len(h)
        text = np.searchsorted(ends, place, side="right")
        last = np.arange(len(key)) + items.must[item] - 1
        full = last < len(key)
        last = np.minimum(last, max(len(key) - 1, 0))
        full &= (item[last] == item) & (text[last] == text) & (place[last] - place < items.reach[item])
        text, item, place = text[full], item[full], place[full]
        reach = items.reach[item]
        yield np.stack([text, item, np.maximum(b.first[text], place - reach + 1), np.minimum(ends[text], place + reach)])


def matches(texts: list[bytes], items: Items, table: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(text, item, cosine, share of the item, share of the answer, first word, last word) of every accepted pair."""
    b = Batch(texts, WORDS, lower=True, apart=True)
    h = b.hashes
    if items.short:
        for t in np.flatnonzero((b.count > 0) & (b.count < LEAST)).tolist():
            n = int(b.count[t])
            for i in items.short.get(h[b.first[t] : b.first[t] + n].tobytes(), ()):
                yield t, i, 1.0, 1.0, 1.0, 0, n
    if not len(h) or not len(items.windows):
        return
    lengths = np.array([len(w) for w in items.words])
    x, text, start = latent(table, b, bucket_of(h))
    hits = list(crowded(b, h, items))
    for at in range(0, len(x), 4096):
        near = x[at : at + 4096] @ items.windows.T
        row = np.flatnonzero(near.max(axis=1) >= COSINE)
        i, q = np.nonzero(near[row] >= COSINE)
        w = at + row[i]
        t, item = text[w], items.owner[q]
        # Where the item would begin in the document if its window lies on this one, and the slack before.
        begin = start[w] - items.offset[q] - (items.reach[item] - lengths[item]) // 2
        hits.append(np.stack([t, item, np.maximum(b.first[t], begin), np.minimum((b.first + b.count)[t], begin + items.reach[item])]))
    text_of, item_of, begin, end = np.concatenate(hits, axis=1)
    by = np.lexsort((begin, item_of, text_of))
    text_of, item_of, begin, end = (v[by].tolist() for v in (text_of, item_of, begin, end))
    k = 0
    while k < len(text_of):
        t, i = text_of[k], item_of[k]
        best = None
        while k < len(text_of) and text_of[k] == t and item_of[k] == i:
            a, z = begin[k], end[k]
            while k < len(text_of) and text_of[k] == t and item_of[k] == i and begin[k] <= z:
                z = max(z, end[k])
                k += 1
            found = best_stretch(h[a:z].tolist(), items, i)
            if found and (best is None or found[0] > best[0]):
                best = (*found[:2], a + found[2], a + found[3])
        if best:
            share, known, a, z = best
            windows = items.windows[items.owner == i]
            over = np.flatnonzero((text == t) & (start < z) & (start + WINDOW > a))
            yield (t, i, float((x[over] @ windows.T).max()), share, known, a - int(b.first[t]), z - int(b.first[t]))


def best_stretch(around: list[int], items: Items, i: int) -> tuple[float, float, int, int] | None:
    """(share of the item, share of the answer, first word, end) of the accepted stretch with most of the item."""
    words, answer, wanted = items.words[i], items.answers[i], items.wanted[i]
    need, reach = int(items.need[i]), int(items.reach[i])
    if common(words, around) < need:
        return None
    # The best stretches begin with a word of the item.
    places = [k for k, w in enumerate(around) if w in wanted]
    best = None
    for k, a in enumerate(places[: len(places) - need + 1]):
        if places[k + need - 1] - a >= reach:
            continue
        stretch = around[a : a + reach]
        share = common(words, stretch) / len(words)
        if share < PARAPHRASE or best is not None and share <= best[0]:
            continue
        known = common(answer, stretch) / len(answer)
        if share >= COPY or known >= ANSWER:
            best = (share, known, a, a + len(stretch))
            if share == 1:
                break
    return best


def item_blocks(benchmark: DataFrame, table: np.ndarray, idf: np.ndarray) -> Iterator[Items]:
    """The benchmark, prepared, ITEMS items at a time."""
    block: list = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            yield prepare([r["item_id"] for r in block], [(r["text"] or "").encode() for r in block], table, idf)
            block = []
    if block:
        yield prepare([r["item_id"] for r in block], [(r["text"] or "").encode() for r in block], table, idf)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share, first_word, last_word of every match."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item_id", "cosine", "item_share", "answer_share", "first_word", "last_word"]
    schema = f"doc_id {kind}, item_id long, cosine double, item_share double, answer_share double, first_word int, last_word int"
    table, idf = latent_space(docs)
    space = spark.sparkContext.broadcast(table)

    def against(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, part in blocks(batch.column(1)):
                    found = list(matches(part, shared.value, space.value))
                    rows = pa.array([start + m[0] for m in found], pa.int64())
                    columns = [batch.column(0).take(rows), pa.array([shared.value.ids[m[1]] for m in found], pa.int64())]
                    columns += [pa.array([m[k] for m in found], pa.float64()) for k in (2, 3, 4)]
                    columns += [pa.array([m[k] for m in found], pa.int32()) for k in (5, 6)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [against(items) for items in item_blocks(benchmark, table, idf)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns; each block of items filters what the others leave."""
    table, idf = latent_space(docs)
    space = docs.sparkSession.sparkContext.broadcast(table)

    def without(left: DataFrame, items: Items) -> DataFrame:
        shared = left.sparkSession.sparkContext.broadcast(items)

        def judge(texts: list[bytes]) -> np.ndarray:
            free = np.ones(len(texts), bool)
            free[[m[0] for m in matches(texts, shared.value, space.value)]] = False
            return free

        return kept_rows(left, lambda: judge)

    return reduce(without, item_blocks(benchmark, table, idf), docs)
