"""Splitting texts into pre-tokens, and batches of them as ragged arrays.

The split is the public pattern of byte-level tokenizers. The tokenizer
libraries follow Unicode 16; the ``regex`` module here knows newer letters and
numbers, so those count as unassigned. Texts below U+0250, nearly all of them
in western languages, take an equal pattern with spelled-out classes, which
the standard engine matches twice as fast.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

# Code points that became letters or numbers after Unicode 16.
NEW_LETTERS = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
NEW_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"

_LIMIT = 0x250


def _pattern(letter: str, number: str, space: str) -> str:
    suffixes = "|".join(f"'{s}" for s in ("s", "t", "re", "ve", "m", "ll", "d"))
    return f"{suffixes}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def _spelled(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind)


_SPACES = "".join(f"\\u{c:04x}" for c in range(_LIMIT) if regex.match(r"\s", chr(c)))
_western = re.compile(_pattern(_spelled("L"), _spelled("N"), _SPACES)).findall
_any = regex.compile(
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d"
    rf"| ?[\p{{L}}--[{NEW_LETTERS}]]+| ?[\p{{N}}--[{NEW_NUMBERS}]]+"
    rf"| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEW_LETTERS}{NEW_NUMBERS}])+|\s+(?!\S)|\s+"
).findall
_beyond = re.compile(f"[^\\u0000-\\u{_LIMIT - 1:04x}]").search


def split(text: str) -> list[str]:
    """The pre-tokens of a text, in order; their concatenation is the text."""
    return _any(text) if _beyond(text) else _western(text)


def tokenizer_file(path: str) -> str:
    """A vocabulary file where this process has it: at its path, or where its package lies here."""
    return path if os.path.exists(path) else public_tokenizers.path(os.path.basename(path))


class Pieces:
    """The different pre-tokens of a batch of texts and where they stand.

    ``unique`` lists them, ``codes`` is the index of each occurrence, and
    ``counts`` the number of occurrences of each text.
    """

    def __init__(self, texts: list[str]):
        found = [split(t) for t in texts]
        self.counts = np.fromiter(map(len, found), np.int64, len(found))
        encoded = pa.array(chain.from_iterable(found), pa.large_string(), size=int(self.counts.sum())).dictionary_encode()
        self.codes = encoded.indices.to_numpy()
        self.unique = encoded.dictionary


def ragged(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings, joined, and the n + 1 offsets."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` of the given lengths."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]
