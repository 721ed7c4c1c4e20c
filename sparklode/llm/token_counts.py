"""Token counts of byte-level BPE by merging whole batches in step.

All different pre-tokens of a batch lie in one ragged array of symbols. In each
round, every sequence finds its lowest-ranked pair and merges all places of
that pair at once; sequences without a pair that merges leave the array. What
counts in the end is the number of surviving symbols.

Merging all places of a pair at once equals merging them one by one: a listed
merge always comes after the merges that make its parts, so no merge makes a
pair of lower rank than its own.

Runs in Arrow batches without a shuffle. Special tokens of the file that stand
in a text are cut out first and count one each, as the library does by default.

Edge cases: null and empty texts count 0; repeated rows and null ids are kept
one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import blocks
from .pretokens import Pieces, by_row, ragged, tokenizer_file

#: Symbols of pre-tokens that are merged in one array.
SYMBOLS = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable Latin-1 for itself, the rest from U+0100 on."""
    out, beyond = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out[chr(b)] = b
        else:
            out[chr(beyond)] = b
            beyond += 1
    return out


class Merges:
    """The merges of a tokenizer file, as sorted pair keys."""

    def __init__(self, path: str):
        with open(tokenizer_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in byte_alphabet().items():
            self.byte_id[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # A table over hashed pairs finds ranks without a search per pair.
        self.none = len(pairs)
        self.table_bits = max(12, (16 * len(pairs)).bit_length())  # a sixteenth full at most
        self._index()
        specials = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.marks = {x[0] for x in specials}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _index(self) -> None:
        """Open addressing with a bounded probe length."""
        size = 1 << self.table_bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, self.none, np.int64)
        left, step = np.arange(len(self.keys)), 0
        slots = self._slot(self.keys)
        while len(left):
            at = (slots[left] + step) & (size - 1)
            open_ = self.slot_key[at] == -1
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= open_
            self.slot_key[at[take]] = self.keys[left[take]]
            self.slot_rank[at[take]] = self.rank[left[take]]
            left, step = left[~take], step + 1
        self.probes = step

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``none`` where it doesn't merge."""
        keys = left * self.base + right
        slots = self._slot(keys)
        out = np.full(len(keys), self.none, np.int64)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            at = (slots[open_] + step) & ((1 << self.table_bits) - 1)
            held = self.slot_key[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return out

    def surviving(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of symbols left of each run of bytes."""
        lengths = np.diff(offsets)
        out = lengths.copy()
        symbols = self.byte_id[data]
        seq = np.repeat(np.arange(len(lengths)), lengths)
        # rank[i]: of the pair (i, i + 1) where both are of one sequence
        rank = np.full(len(symbols), self.none, np.int64)
        inner = np.flatnonzero(seq[:-1] == seq[1:]) if len(seq) else np.zeros(0, np.int64)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            sizes = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(rank, starts)
            active = low < self.none
            if not active.all():
                out[seq[starts]] = sizes
                keep = np.repeat(active, sizes)
                symbols, seq, rank, low, sizes = symbols[keep], seq[keep], rank[keep], low[active], sizes[active]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(low, sizes)
            # Of touching places of one pair (a a a), every second merges, from the left.
            at = np.flatnonzero(chosen)
            run = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            new = place[at]
            rank[at] = self.none
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            # Only pairs beside a merge have changed.
            changed = np.zeros(len(symbols), bool)
            changed[new] = True
            changed[new[new > 0] - 1] = True
            touched = np.flatnonzero(changed)
            pairs = touched[touched + 1 < len(symbols)]
            pairs = pairs[seq[pairs] == seq[pairs + 1]]
            rank[touched] = self.none
            rank[pairs] = self.ranks(symbols[pairs], symbols[pairs + 1])
        return out

    def count_pieces(self, unique: pa.LargeStringArray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        data, offsets = ragged(unique)
        out = np.zeros(len(unique), np.int64)
        at = 0
        while at < len(unique):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SYMBOLS, "right")) - 1)
            out[at:stop] = self.surviving(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
            at = stop
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = [t]
            if any(c in t for c in self.marks):
                cut = self.special.split(t)
                extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        pieces = Pieces(parts)
        each = by_row(self.count_pieces(pieces.unique)[pieces.codes], pieces.counts)
        return extra + np.bincount(np.array(owner, np.int64), weights=each, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One table of merges per worker process and file."""
    return Merges(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, part in blocks(texts):
                n = m.count(part)
                size = [len(t.encode()) for t in part]
                columns = [batch.column(0).slice(start, len(part)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
