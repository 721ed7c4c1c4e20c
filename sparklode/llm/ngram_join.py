"""N-gram Jaccard self-join: a size-aware heavy-light join over shingle sets.

Two documents link when their sets of word shingles have a Jaccard similarity
of the threshold or more; components of links are returned. The steps:

1. Every text becomes its set of shingle hashes. Equal sets are one class from
   here on, so that copies cost one set. All shingles are counted (each once a
   class and run of texts), and the frequent ones are *heavy*.
2. Keys. Small sets enumerate fixed-size subsets: sets of sizes a and b link
   exactly if they share a subset of the needed overlap o(a, b), so a set lists
   its o(a, b)-subsets for each partner size b. Large sets scan inverted lists
   of shingles: light ones first and heavy ones last by frequency, a set of n
   need only be listed under its first n - ceil(t n) + 1 shingles. The
   boundary between small and large is the size up to which subsets cost less
   than lists, by the list lengths of this corpus.
3. Under each key the sets link to one leader first (a star, not all pairs),
   the set that has the fewest rarer shingles. Pairs whose parity sketches
   prove too many differences go; the others are verified on whole sets, and
   components follow.
4. Only keys whose sets then still lie in different components are looked at
   again. Their sets meet in cells of ``CELL`` at most, with their sketches: of
   each two components that meet in a cell the closest pairs that sizes, places
   and sketches allow leave it, more in every round (``ROUNDS``), until a round
   has held back none. So no link between components is lost, pairs that cannot
   link never become rows, and two components joined by many pairs cost a few.

Very frequent keys are spread over salts whose leaders meet again, and joins
that may be skewed are plain equi-joins, which adaptive execution splits.

Sets are known by 64-bit digests and shingles by 64-bit hashes: of ten billion
different sets about three pairs are expected to share a digest. Links are
settled on shingle hashes.

Edge cases: null and empty texts and texts without words have an empty set and
link with nothing; with fewer words than a shingle the whole sequence is one.
Each row is a document of its own: rows without an id or of one id link by
their texts alone, like all others. A component without any id has none;
otherwise the smallest id names it, and where ids tie, the rows are told apart
by their texts' and then by all columns' hashes. Texts of any length are read
whole; columns beyond doc_id and text are passed through by ``one_of_each`` and
ignored elsewhere, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import connected, joined
from .pretokens import ragged
from .wordhash import SPACES, Batch, blocks, mix

#: Texts with a shingle from which on it is heavy, and the number of heavy ones kept in order.
HEAVY, MAX_HEAVY = 16, 1 << 19
#: Ranges of hashes in which shingles are counted.
PARTS = 4096
#: No set above this size enumerates subsets, whatever the costs.
LARGEST_SMALL = 16
#: Listed sets of a key that go to one task; more are salted.
SALT_AT = 200_000
#: What verifying a pair costs, in list rows.
VERIFY = 40.0
#: Rows of an unfinished list that are held before they are passed on.
HOLD = 50_000
#: Places of the longest sketch.
MAX_PLACES = 1 << 14
#: Sets that meet at once in a key that holds several components.
CELL = 4096
#: Pairs of two components that leave a cell, by round; the last one holds back none.
ROUNDS = (1, 32, 1 << 62)
#: Rows read before their cells are worked off, and pairs compared at once.
READ, PAIRS = 20_000, 500_000

_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(64)]


@dataclass(frozen=True)
class Rule:
    """Links where ``100 * intersection >= percent * union`` over shingles of ``words`` words."""

    words: int = 5
    percent: int = 75

    def overlap(self, a: int, b: int) -> int:
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def may_link(self, n, at, m, to):
        """Whether sets of sizes n and m may link that share the shingle at places ``at`` and ``to`` of their orders.

        Linked sets share a shingle among the first n - o(n, m) + 1 of the one
        and the first m - o(n, m) + 1 of the other.
        """
        need = -(-self.percent * (n + m) // (100 + self.percent))
        return (at <= n - need) & (to <= m - need)

    def largest(self, n: int) -> int:
        """The largest size that links with size n."""
        return 100 * n // self.percent

    def least(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def prefix(self, n: np.ndarray | int):
        """How many shingles of a set of n must be listed."""
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(texts: list[bytes], rule: Rule) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    b = Batch(texts, SPACES, lower=True)
    h, k = b.hashes, rule.words
    if len(h) >= k:
        rolled = sum(h[j : len(h) - k + 1 + j] * _STEP[j] for j in range(k))
        rolled = mix(rolled)
    out = []
    for first, count in zip(b.first.tolist(), b.count.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(rolled[first : first + count - k + 1]))
        elif count:
            own = h[first : first + count] * np.array(_STEP[:count])
            out.append(mix(own.sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(h[:0])
    return out


def digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return int(mix(mix(s ^ place).sum(keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's elements by hashed place: the sketches of two sets differ in no more places than the sets do.

    As many places as twice the set, rounded up to a power of two; a longer
    sketch folds to a shorter one.
    """
    places = 64
    while places < min(2 * len(s), MAX_PLACES):
        places *= 2
    at = ((s >> np.uint64(17)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=places) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the number of elements in which two sets differ, by their sketches."""
    if len(a) < len(b):
        a, b = b, a
    x, places = int.from_bytes(a, "little"), 8 * len(a)
    while places > 8 * len(b):
        places //= 2
        x = (x >> places) ^ (x & ((1 << places) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not re.search("map|variant", f.dataType.simpleString())])


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """id, row (hash of all columns), said (hash of the text), cls, n and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in blocks(batch.column(3)):
                sets = shingle_sets(part, rule)
                own = [batch.column(i).slice(start, len(part)) for i in range(3)]
                found = [pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *found], names=["id", "row", "said", "cls", "n", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash(docs), F.xxhash64("text"), "text")
    return rows.mapInArrow(run, "id long, row long, said long, cls long, n long, sketch binary")


def count_shingles(docs: DataFrame, rule: Rule, least: int = 1) -> DataFrame:
    """(shingle, n): how often each shingle stands in the classes, counted once in a run of texts; those of ``least`` or more.

    Shingles go from task to task as arrays, a row for each of ``PARTS`` ranges of hashes and run.
    """
    edges = np.array([(i << 64) // PARTS for i in range(1, PARTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            part = np.flatnonzero(np.diff(at))
            at = np.append(at[part], len(keys))
            columns = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (keys, n.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *columns], names=["part", "keys", "counts"])

        for batch in batches:
            for _, part in blocks(batch.column(0)):
                for s in shingle_sets(part, rule):
                    if len(s) and (c := digest(s)) not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield counted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []

        def summed() -> pa.RecordBatch:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            each, total = np.unique(keys, return_counts=True)
            more = n > 1  # few are in a run
            total = total + np.bincount(np.searchsorted(each, keys[more]), weights=n[more] - 1.0, minlength=len(each)).astype(np.int64)
            keep = total >= least
            return pa.RecordBatch.from_arrays([pa.array(each[keep].view(np.int64)), pa.array(total[keep])], names=["shingle", "n"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            if not len(parts):
                continue
            (keys, key), (counts, count) = (ragged(batch.column(c).cast(pa.large_binary())) for c in (1, 2))
            edge = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]]).tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if held and parts[a] != at:
                    yield summed()
                    held.clear()
                at = parts[a]
                held.append((keys[key[a] : key[b]].view(np.uint64), counts[count[a] : count[b]].view(np.uint32)))
        if held:
            yield summed()

    found = docs.select("text").mapInArrow(run, "part int, keys binary, counts binary")
    return found.repartition("part").sortWithinPartitions("part").mapInArrow(add, "shingle long, n long")


@dataclass
class Order:
    """The heavy shingles, sorted, with their frequencies; the largest size that enumerates subsets."""

    heavy: np.ndarray
    count: np.ndarray
    small: int

    def arrange(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set in listing order, and each shingle's frequency if heavy, else 0."""
        often = np.zeros(len(s), np.int64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, s), len(self.heavy) - 1)
            often = np.where(self.heavy[at] == s, self.count[at], 0)
            if often.any():
                by = np.argsort(often, kind="stable")  # hashes are sorted already
                return s[by], often[by]
        return s, often


def subset_cost(n: int, rule: Rule) -> int:
    """Keys that a set of size n enumerates for all partner sizes."""
    return sum(comb(n, rule.overlap(n, b)) for b in range(rule.least(n), rule.largest(n) + 1))


def boundary(rule: Rule, met: float) -> int:
    """The largest size whose subsets cost no more than its lists, which hold ``met`` other sets on average."""
    small = 0
    for n in range(1, LARGEST_SMALL + 1):
        if subset_cost(n, rule) <= rule.prefix(n) * (1 + met * VERIFY):
            small = n
    return small


def met_in_lists(singles: float, repeated: list[tuple[float, float]], rule: Rule) -> float:
    """How many other sets a list of a prefix holds on average.

    A prefix takes the rarest shingles, a share of 1 - t: ``singles`` that stand
    once come first, then the ``repeated`` (number of shingles, standings) by frequency.
    """
    total = singles + sum(standings for _, standings in repeated)
    room = taken = max(total * (100 - rule.percent) / 100, 1.0)
    room, met = room - min(room, singles), 0.0
    for shingles, standings in sorted(repeated, key=lambda x: x[1] / x[0]):
        part = min(room, standings)
        met += part * (standings / shingles - 1)
        room -= part
    return met / taken


def heavy_order(docs: DataFrame, described: DataFrame, rule: Rule) -> Order:
    """The heavy shingles of the corpus (the MAX_HEAVY most frequent) and the boundary that its list lengths give."""
    counted = stored(count_shingles(docs, rule, 2), "frequencies")
    found = counted.where(F.col("n") >= HEAVY).orderBy(F.desc("n"), "shingle").limit(MAX_HEAVY).toPandas()
    # A row for each power of two.
    repeated = [(r["shingles"], r["standings"]) for r in counted.groupBy(F.floor(F.log2("n"))).agg(F.count("*").alias("shingles"), F.sum("n").alias("standings")).collect()]
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    discard(counted)
    keys, count = found["shingle"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    by = np.argsort(keys)
    singles = max(0, total - sum(standings for _, standings in repeated))
    return Order(keys[by], count[by], boundary(rule, met_in_lists(singles, repeated, rule)))


def keys_of(s: np.ndarray, order: Order, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys under which a set is listed, how often each is expected to be, and its place in the order (-1: a subset)."""
    n = len(s)
    out, often, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > order.small or rule.largest(n) > order.small:
        arranged, count = order.arrange(s)
        p = int(rule.prefix(n))
        out, often, place = arranged[:p], count[:p], np.arange(p)
    if 0 < n <= order.small:
        subsets = []
        for b in range(rule.least(n), min(rule.largest(n), order.small) + 1):
            tag = np.uint64(min(n, b) * 64 + max(n, b))
            picks = np.array(list(combinations(range(n), rule.overlap(n, b))))
            subsets.append(mix(mix(s[picks]).sum(axis=1) * np.uint64(3) + tag))
        subsets = np.concatenate(subsets)
        none = np.zeros(len(subsets), np.int64)
        out, often, place = np.concatenate([out, subsets]), np.concatenate([often, none]), np.concatenate([place, none - 1])
    return out, often, place


def listed(docs: DataFrame, order: Order, rule: Rule) -> DataFrame:
    """(key, salt, cls, n, place): each class under its keys, once a partition; salt -1 where a key has one list."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                keys, salts, owners, sizes, places = [], [], [], [], []
                for s in shingle_sets(part, rule):
                    if not len(s) or (c := digest(s)) in seen:
                        continue
                    seen.add(c)
                    own, often, place = keys_of(s, shared.value, rule)
                    keys.append(own)
                    salts.append(np.where(often > SALT_AT, c % np.maximum(-(-often // SALT_AT), 1), -1))
                    owners.append(np.full(len(own), c, np.int64))
                    sizes.append(np.full(len(own), len(s), np.int32))
                    places.append(place.astype(np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                        names=["key", "salt", "cls", "n", "place"],
                    )

    return docs.select("text").mapInArrow(run, "key long, salt int, cls long, n int, place int")


def stars(lists: DataFrame, rule: Rule) -> DataFrame:
    """What the lists say, read as a sorted stream. The leader is the set with the fewest shingles before the key's:

    kind 0 (a = leader, b = member, n = keys in common) of pairs that may link;
    kind 1 (key, a = class, b = place, n = size) of lists of three classes or more, and of salted ones;
    kind 2 (key, a = leader, n = size) of salted lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "a", "b", "n"]

        def rows(kind: int, key, a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], names=names)

        def read(key, salt, cls, n, place, cut: bool, whole: bool = True) -> Iterator[pa.RecordBatch]:
            """Lists; ``cut``: the first row is the leader of a list whose start was passed on before; not ``whole``: a list that goes on."""
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            starts = np.flatnonzero(first)
            count = np.diff(np.append(starts, len(key)))
            lead = np.repeat(starts, count)
            member = ~first
            pair = np.flatnonzero(member & rule.may_link(n.astype(np.int64), place, n[lead].astype(np.int64), place[lead]))
            if len(pair):
                both, times = np.unique(np.stack([cls[lead[pair]], cls[pair]], 1), axis=0, return_counts=True)
                yield rows(0, np.zeros(len(both), np.int64), both[:, 0], both[:, 1], times)
            # Two members of an unsalted list are the star itself.
            long = np.repeat((count > 2) | (cut & (starts == 0)) | (salt[starts] >= 0) | (not whole), count)
            if cut:
                long[0] = False
            at = np.flatnonzero(long)
            if len(at):
                yield rows(1, key[at], cls[at], place[at].astype(np.int64), n[at])
            spread = starts[salt[starts] >= 0]
            if len(spread):
                yield rows(2, key[spread], cls[spread], np.zeros(len(spread), np.int64), n[spread])

        held, cut = None, False
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(5)]
            if not len(new[0]):
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            key, salt, cls, *_ = held
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (cls[1:] == cls[:-1])])
            held = key, salt, cls, *_ = [x[~again] for x in held]
            last = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield from read(*(x[:done] for x in held), cut)
                held, cut = [x[done:] for x in held], False
            if len(held[0]) > HOLD:
                yield from read(*held, cut, whole=False)
                # The leader stays for what follows.
                held, cut = [x[[0]] for x in held], True
        if held is not None:
            yield from read(*held, cut)

    dealt = lists.repartition("key", "salt").sortWithinPartitions("key", "salt", "place", "cls")
    return dealt.mapInArrow(run, "kind int, key long, a long, b long, n long")


def plausible(pairs: DataFrame, named: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``pairs`` (a, b, n) whose sizes and sketches allow a link."""
    said = named.select("cls", "size", "sketch")
    both = pairs.join(said.toDF("a", "size_a", "sketch_a"), "a").join(said.toDF("b", "size_b", "sketch_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, s, t = (batch.column(i).to_pylist() for i in range(3, 7))
            keep = [least_difference(u, v) <= n + m - 2 * rule.overlap(n, m) for n, m, u, v in zip(x, y, s, t, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)], names=["a", "b", "n"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, n long")


def texts_of(classes: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text): one text of each class of ``classes`` (cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for h in batch.column(0).to_pylist():
                new.append(h not in seen)
                seen.add(h)
            yield batch.filter(pa.array(new, pa.bool_()))

    # Copies go where they are read, so that no text is shuffled more than once a task.
    first = docs.select(F.xxhash64("text").alias("said"), "text").mapInArrow(run, "said long, text string")
    return first.join(classes.join(named.select("cls", "said"), "cls"), "said").dropDuplicates(["said"]).select("cls", "text")


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            links = np.zeros(len(a), bool)
            for (start, left), (_, right) in zip(_in_step(batch.column(2)), _in_step(batch.column(3)), strict=True):
                x, y = shingle_sets(left, rule), shingle_sets(right, rule)
                for i, (s, t) in enumerate(zip(x, y, strict=True)):
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    links[start + i] = 100 * shared >= rule.percent * (len(s) + len(t) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], names=["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def _in_step(column: pa.Array, rows: int = 64) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), rows):
        yield at, [t or b"" for t in column.slice(at, rows).cast(pa.large_binary()).to_pylist()]


class Sketches:
    """Sketches of rows as matrices of words, a matrix for each length; longer ones fold to shorter ones."""

    def __init__(self, sketches: list[bytes]):
        size = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        self.size, self.at, self.of = size, np.zeros(len(size), np.int64), {}
        for words in np.unique(size).tolist():
            rows = np.flatnonzero(size == words)
            self.at[rows] = np.arange(len(rows))
            self.of[words, words] = np.frombuffer(b"".join([sketches[i] for i in rows.tolist()]), np.uint64).reshape(-1, words)

    def folded(self, words: int, to: int) -> np.ndarray:
        if (words, to) not in self.of:
            wide = self.folded(words, 2 * to)
            self.of[words, to] = wide[:, :to] ^ wide[:, to:]
        return self.of[words, to]

    def differences(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lower bounds on the number of elements in which the sets of rows x and y differ."""
        out = np.zeros(len(x), np.int64)
        kinds = self.size[x] << 20 | self.size[y]
        for kind in np.unique(kinds).tolist():
            p, q = kind >> 20, kind & 0xFFFFF
            to = min(p, q)
            left, right = self.folded(p, to), self.folded(q, to)
            rows = np.flatnonzero(kinds == kind)
            step = max(1, 4_000_000 // to)
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                out[r] = np.bitwise_count(left[self.at[x[r]]] ^ right[self.at[y[r]]]).sum(1, dtype=np.int64)
        return out


def closest(cell: np.ndarray, at: np.ndarray, cls: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The ``budget`` closest pairs of every two components in a cell, and whether others were held back."""
    turned = at[x] > at[y]
    x, y = np.where(turned, y, x), np.where(turned, x, y)
    by = np.lexsort((cls[y], cls[x], far, at[y], at[x], cell[x]))
    x, y, far = x[by], y[by], far[by]
    new = np.concatenate([[True], (cell[x][1:] != cell[x][:-1]) | (at[x][1:] != at[x][:-1]) | (at[y][1:] != at[y][:-1])]) if len(x) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    keep = rank < budget
    return x[keep], y[keep], far[keep], not keep.all()


def meet(members: DataFrame, named: DataFrame, rule: Rule, budget: int) -> DataFrame:
    """(kind, a, b): kind 0, pairs of classes in different components that a key brings together and that may link, ``budget`` of every two components and cell; kind 1, a cell that held back others.

    ``members`` (key, cls, n, place, at, count) of keys with several components. Keys of
    more than CELL sets are cut into blocks, and every two blocks meet in a cell.
    """
    cut = members.withColumn("cuts", F.ceil(F.col("count") / CELL).cast("int"))
    own = F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "n", "place", "at")
    cells = cells.join(named.select("cls", "sketch"), "cls").select("key", "i", "j", "side", "cls", "n", "place", "at", "sketch")

    def compared(cols: list[np.ndarray], sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Of whole cells, sorted by cell and side: the classes of the pairs, and whether some were held back."""
        key, i, j, side, cls, n, place, at = cols
        rows = np.arange(len(key))
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        cell = np.cumsum(edge) - 1
        stop = np.append(np.flatnonzero(edge)[1:], len(key))[cell]
        # A block meets itself, each row those after it; or side 0 meets side 1.
        first = np.bincount(cell, weights=side == 0).astype(np.int64)[cell] + np.flatnonzero(edge)[cell]
        low = np.where(i == j, rows + 1, first)
        count = np.where((i == j) | (side == 0), stop - low, 0)
        said, held = Sketches(sketches), [np.zeros(0, np.int64)] * 3
        back, turn = False, np.cumsum(count) // PAIRS
        for t in np.unique(turn).tolist():
            own = np.flatnonzero(turn == t)
            x = np.repeat(own, count[own])
            y = np.arange(len(x)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + np.repeat(low[own], count[own])
            fits = (at[x] != at[y]) & rule.may_link(n[x], place[x], n[y], place[y])
            x, y = x[fits], y[fits]
            far = said.differences(x, y)
            near = far <= n[x] + n[y] - 2 * -(-rule.percent * (n[x] + n[y]) // (100 + rule.percent))
            held = [np.concatenate(z) for z in zip(held, (x[near], y[near], far[near]), strict=True)]
            if len(held[0]) > PAIRS:
                *held, over = closest(cell, at, cls, *held, budget)
                back |= over
                if len(held[0]) > PAIRS:  # all of them leave
                    yield cls[held[0]], cls[held[1]], False
                    held = [np.zeros(0, np.int64)] * 3
        x, y, _, over = closest(cell, at, cls, *held, budget)
        yield cls[x], cls[y], back or over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cols: list[np.ndarray], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
            for a, b, back in compared(cols, sketches):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                kind = np.append(np.zeros(len(pairs), np.int32), np.ones(int(back), np.int32))
                pairs = np.concatenate([pairs, np.zeros((int(back), 2), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["kind", "a", "b"])

        held, sketches = None, []
        for batch in batches:
            new = [batch.column(c).to_numpy().astype(np.int64) for c in range(8)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            sketches += batch.column(8).to_pylist()
            if len(sketches) < READ:
                continue
            whole = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
            done = whole[-1] + 1 if len(whole) else 0
            if done:
                yield from rows([x[:done] for x in held], sketches[:done])
                held, sketches = [x[done:] for x in held], sketches[done:]
        if sketches:
            yield from rows(held, sketches)

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cls")
    return dealt.mapInArrow(run, "kind int, a long, b long")


def link_classes(docs: DataFrame, rule: Rule, described: DataFrame) -> DataFrame:
    """(node, component) of all classes that link with another."""
    order = heavy_order(docs, described, rule)
    said = stored(stars(listed(docs, order, rule), rule), "lists")
    named = described.where("n > 0").groupBy("cls").agg(F.min("said").alias("said"), F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    named = stored(named, "classes")
    near = said.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Leaders of one salted list meet in the least of them.
    salted = said.where("kind = 2").select("key", "a", "n").distinct()
    least = salted.groupBy("key").agg(F.min("a").alias("lead"))
    together = salted.join(least, "key").where("a > lead").select(F.col("lead").alias("a"), F.col("a").alias("b")).distinct()
    near = near.union(together.select("a", "b", F.lit(1 << 40).alias("n"))).groupBy("a", "b").agg(F.max("n").alias("n"))
    near = stored(plausible(near, named, rule), "near")
    member = stored(said.where("kind = 1").select("key", F.col("a").alias("cls"), F.col("b").cast("int").alias("place"), F.col("n").cast("int").alias("n")).distinct(), "members")
    discard(said)
    classes = near.select(F.explode(F.array("a", "b")).alias("cls")).union(member.select("cls")).distinct()
    texts = stored(texts_of(classes, named, docs), "texts")

    # First each class with the leader it shares most keys with, then its other leaders in other components ...
    best = stored(near.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "best")
    parts = connected(verify(best, texts, rule))
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    others = stored(across(others, parts), "others")
    if not others.isEmpty():
        parts, tried = joined(parts, verify(others, texts, rule)), tried.union(others)

    # ... then whatever a key holds in different components.
    late = []
    for budget in ROUNDS:
        apart = stored(lists_apart(member, parts), "apart")
        found = stored(meet(apart, named, rule, budget), "met")
        new = stored(found.where("kind = 0").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "late")
        if not new.isEmpty():
            parts, tried = joined(parts, verify(new, texts, rule)), tried.union(new)
        late += [found, new]
        discard(apart)
        if found.where("kind = 1").isEmpty():
            break
    discard(named, near, member, texts, best, others, *late)
    return parts


def placed(df: DataFrame, parts: DataFrame, col: str, name: str) -> DataFrame:
    """Adds the component of a class; a class without links is its own."""
    return df.join(parts.toDF(col, "__at"), col, "left").withColumn(name, F.coalesce("__at", col)).drop("__at")


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs between different components."""
    return placed(placed(pairs, parts, "a", "at_a"), parts, "b", "at_b").where("at_a != at_b").select("a", "b")


def lists_apart(member: DataFrame, parts: DataFrame) -> DataFrame:
    """The members (key, cls, n, place, at, count) of keys that hold more than one component."""
    now = placed(member, parts, "cls", "at")
    apart = now.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("count")).where("lo < hi")
    return now.join(apart, "key").select("key", "cls", "n", "place", "at", "count")


def components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    described = stored(describe(docs, rule), "sets")
    linked = link_classes(docs, rule, described)
    rows = described.select(F.col("id").alias("doc_id"), "cls", F.col("n").alias("n_shingles"))
    named = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    placed = named.join(linked.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = placed.join(first, "component").select("cls", "component_id")
    return (
        rows.join(of_class, "cls", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id")
    )


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents, one row of each component: that of the smallest doc_id (rows without one come last); rows without words all stay."""
    described = stored(describe(docs, rule), "sets")
    linked = link_classes(docs, rule, described)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "said", "row")
    first = described.where("n > 0").groupBy("cls").agg(F.min(own).alias("own"))
    of_class = first.join(linked.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    keep = stored(of_class.groupBy("component").agg(F.min("own").alias("own")).select(F.col("own.said").alias("__said"), F.col("own.row").alias("__row")), "keep")
    discard(described, linked)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # One shuffle of the texts serves the join and the choice of one of equal rows.
    hashed = docs.withColumn("__said", F.xxhash64("text")).withColumn("__row", row_hash(docs))
    chosen = hashed.where(~wordless).join(keep, ["__row", "__said"], "left_semi").dropDuplicates(["__row", "__said"])
    return chosen.select(docs.columns).union(docs.where(wordless))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh
  FROM w
), e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""
