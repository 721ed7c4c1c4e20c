"""Byte-level BPE: encode and decode by a file of ranks.

Two tiers. Whole pre-tokens that are vocabulary entries are found by a minimal
perfect hash over the vocabulary, probed for a batch of different pre-tokens
at once and settled by comparing bytes. The others are merged with a heap over
a doubly linked list of bytes, so that a pre-token of n bytes takes
O(n log n) however long it is.

Runs row by row in Arrow batches: no shuffle, memory bounded by a batch.
Different pre-tokens are encoded once a batch; a worker keeps a bounded memo.

Edge cases: null and empty texts have no ids; repeated rows and null ids are
kept one for one; an empty table gives an empty result; columns beyond the key
and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Pieces, ragged, spread, tokenizer_file

#: Entries of a worker's memo of merged pre-tokens; it is emptied when full.
MEMO = 600_000
#: Characters of text worked on at once.
BLOCK = 4_000_000

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def piece_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty run of bytes."""
    lengths = np.diff(offsets)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[within], offsets[:-1])
    sums ^= lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = (sums ^ (sums >> np.uint64(33))) * _MIX
    return sums ^ (sums >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, then displace each bucket into free slots."""

    def __init__(self, keys: list[bytes]):
        self.lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(keys), np.uint8)
        hashes = piece_hashes(self.data, self.offsets)
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            self._place(np.flatnonzero(sizes == size), size, order, starts, hashes)
        free = self.key_at < 0
        # Buckets of one take what is left over, named directly.
        for b, slot in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free), strict=True):
            self.shift[b] = -1 - slot
            self.key_at[slot] = order[starts[b]]

    def _place(self, open_: np.ndarray, size: int, order: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> None:
        """Give all buckets of one size their shifts: each tries shift after shift; of rivals for a slot the first wins."""
        shift = 0
        while len(open_):
            members = order[starts[open_][:, None] + np.arange(size)]
            slots = self._slots(hashes[members], np.full(members.shape, shift, np.int64))
            _, first = np.unique(slots, return_index=True)
            wins = np.zeros(slots.size, bool)
            wins[first] = True
            fits = (wins.reshape(slots.shape) & (self.key_at[slots] < 0)).all(1)
            self.key_at[slots[fits]] = members[fits]
            self.shift[open_[fits]] = shift
            open_, shift = open_[~fits], shift + 1

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes >> np.uint64(7)) + (hashes | np.uint64(1)) * (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        return ((mixed >> np.uint64(11)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The key index of each run of bytes, -1 where it is no key."""
        hashes = piece_hashes(data, offsets)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))
        found = self.key_at[slots]
        lengths = np.diff(offsets)
        found[self.lengths[found] != lengths] = -1
        held = np.flatnonzero(found >= 0)
        if len(held):
            n = lengths[held]
            same = data[spread(offsets[:-1][held], n)] == self.data[spread(self.offsets[:-1][found[held]], n)]
            equal = np.logical_and.reduceat(same, np.cumsum(n) - n)
            found[held[~equal]] = -1
        return found


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: always merge the lowest rank, leftmost first."""
    n = len(piece)
    get = ranks.get
    # Symbols are linked by their ends: the next one starts where this one ends.
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    pair = [get(piece[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    heap = [r * n + i for i, r in enumerate(pair) if r is not None]
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if pair[i] != r:
            continue
        j = end[i]
        pair[j] = None
        end[i] = k = end[j]
        if k < n:
            before[k] = i
            pair[i] = r = get(piece[i : end[k]])
            if r is not None:
                heappush(heap, r * n + i)
        else:
            pair[i] = None
        if i:
            h = before[i]
            pair[h] = r = get(piece[h:k])
            if r is not None:
                heappush(heap, r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes by the ranks of a file of ``base64 rank`` lines."""

    def __init__(self, path: str):
        with open(tokenizer_file(path), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        keys = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(keys))
        self.hash = PerfectHash(keys)
        self.bytes_of = [b""] * (int(self.ids.max()) + 1)
        for key, i in self.ranks.items():
            self.bytes_of[i] = key
        self.memo: dict[bytes, list[int]] = {}

    def encode_pieces(self, unique: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each pre-token, joined, and their counts."""
        key = self.hash.lookup(*ragged(unique)) if len(unique) else np.zeros(0, np.int64)
        counts = np.ones(len(unique), np.int64)
        missed = np.flatnonzero(key < 0)
        merged = []
        memo, ranks = self.memo, self.ranks
        for piece in unique.take(pa.array(missed)).cast(pa.large_binary()).to_pylist():
            ids = memo.get(piece)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = merge_bytes(piece, ranks)
                if len(piece) <= 64:
                    memo[piece] = ids
            merged.append(ids)
        counts[missed] = [len(x) for x in merged]
        out = np.zeros(int(counts.sum()), np.int64)
        starts = np.cumsum(counts) - counts
        whole = key >= 0
        out[starts[whole]] = self.ids[key[whole]]
        out[spread(starts[missed], counts[missed])] = np.fromiter(chain.from_iterable(merged), np.int64)
        return out, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = Pieces(texts)
        ids, counts = self.encode_pieces(pieces.unique)
        starts = np.cumsum(counts) - counts
        lengths = counts[pieces.codes]
        flat = ids.astype("<u4")[spread(starts[pieces.codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(pieces.counts)]
        return np.split(flat, ends[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of the texts (null as empty) of about ``limit`` characters, with their first index."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, [x or "" for x in texts[start : i + 1]]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, [x or "" for x in texts[start:]]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", digests_only: bool = False) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 of every row, with ``ids`` unless ``digests_only``.

    ``decoded_sha256`` is that of the bytes which the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, part in blocks(texts):
                ids = c.encode(part)
                columns = [
                    batch.column(0).slice(start, len(part)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids]),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>")
    return docs.select(key, "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the ``text`` of the column ``ids``; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
