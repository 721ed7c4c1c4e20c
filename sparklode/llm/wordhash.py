"""Batches of texts as arrays of token hashes, without a Python loop over tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
BLOCK = 1_000_000

_POINT = np.uint64(0x9DDFEA08EB382D69)
_POINT_INVERSE = np.uint64(pow(int(_POINT), -1, 1 << 64))
_BYTE = np.random.default_rng(2024).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Classes of bytes: 0 separates tokens, equal neighbours are of one token.
SPACES = np.ones(256, np.uint8)
SPACES[[9, 10, 11, 12, 13, 32]] = 0
#: Letters (and all of UTF-8 beyond ASCII), digits, other signs.
KINDS = np.full(256, 3, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2
KINDS[[*range(33), 127]] = 0
#: Letters alone; all else separates.
LETTERS = (KINDS == 1).astype(np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, BLOCK + 65536), base, np.uint64)
        held[0] = 1
        held = _powers[name] = np.multiply.accumulate(held)
    return held[:n]


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters begin and end that are written without spaces: kana and Han, Thai and Lao."""
    lead = np.flatnonzero(data >= 0xE0)
    one, two = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    wide = (one == 0xF0) & (two >= 0xA0)
    some = ((one >= 0xE3) & (one <= 0xE9)) | ((one == 0xE0) & (two >= 0xB8) & (two <= 0xBB)) | wide
    start = lead[some]
    return np.concatenate([start, np.minimum(start + 3 + wide[some], len(data) - 1)])


class Batch:
    """Some texts as one byte array with a separator after each.

    ``first`` and ``count`` are each text's run of tokens; ``starts`` and
    ``ends`` bound each token in ``data``; ``hashes`` identifies it. With
    ``apart`` each character of a script that is written without spaces is a token.
    """

    def __init__(self, texts: list[bytes], kinds: np.ndarray, lower: bool, apart: bool = False):
        self.data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        kind = kinds[self.data]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        kind[ends] = 0
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if apart and len(more := unspaced(self.data)):
            edge = np.union1d(edge, more[more > 0])
        bounds = np.concatenate([[0], edge, [len(kind)]])
        token = kind[bounds[:-1]] > 0
        self.starts, self.ends = bounds[:-1][token], bounds[1:][token]
        stop = np.searchsorted(self.starts, ends)
        self.first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        self.count = stop - self.first

    @property
    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("up", _POINT, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _power("down", _POINT_INVERSE, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a text column (null as empty) as UTF-8, about ``limit`` bytes each, with their first row."""
    start, size, part = 0, 0, []
    for at in range(0, len(column), 256):  # a batch is never held twice
        for i, t in enumerate(column.slice(at, 256).cast(pa.large_binary()).to_pylist(), at):
            t = t or b""
            part.append(t)
            size += len(t)
            if size >= limit:
                yield start, part
                start, size, part = i + 1, 0, []
    if part:
        yield start, part


def per_text(values: np.ndarray, batch: Batch) -> np.ndarray:
    """Sums of token values by text."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[batch.first + batch.count] - sums[batch.first]
