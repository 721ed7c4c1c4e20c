"""Word segmentation of texts without spaces: a tokenizer for lexical search in Chinese.

A dictionary segmenter takes, of all ways to cut a run of Han characters into
dictionary words and single characters, the most probable one by word
frequencies. Without a dictionary, overlapping pairs of characters serve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import non_blank

_RUNS = re.compile(r"[一-鿿]+|[A-Za-z0-9]+(?:\.[0-9]+)?|\s+|.", re.S)


class Segmenter:
    """Cuts texts by a dictionary {word: frequency}; other scripts in runs of letters and digits, every other sign alone."""

    def __init__(self, words: dict[str, float]):
        total = math.log(sum(words.values()) or 1.0)
        self.cost = {w: math.log(max(n, 1e-9)) - total for w, n in words.items()}
        self.longest = max(map(len, words), default=1)
        self.unknown = min(self.cost.values(), default=0.0) - 1.0

    def best(self, run: str) -> list[str]:
        """The cut of highest summed log frequency; among equals the longest first word."""
        score, step = [0.0] * (len(run) + 1), [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            score[i] = self.cost.get(run[i], self.unknown) + score[i + 1]
            for n in range(2, min(self.longest, len(run) - i) + 1):
                known = self.cost.get(run[i : i + n])
                if known is not None and known + score[i + n] >= score[i]:
                    score[i], step[i] = known + score[i + n], n
        out, at = [], 0
        while at < len(run):
            out.append(run[at : at + step[at]])
            at += step[at]
        return out

    def cut(self, text: str) -> list[str]:
        return [w for run in _RUNS.findall(text or "") for w in (self.best(run) if "一" <= run[0] <= "鿿" else [run])]


def pairs(text: str) -> list[str]:
    """Overlapping pairs of neighbouring Han characters (a single one stays), and other runs whole."""
    return [w for run in _RUNS.findall(text or "") for w in ([run[i : i + 2] for i in range(max(1, len(run) - 1))] if "一" <= run[0] <= "鿿" else [run])]


def chinese_tokens(words: dict[str, float] | None = None) -> Callable[[Column], Column]:
    """A tokenizer of a text column, with case kept and blank tokens left out; ``words`` is the dictionary."""
    cut = Segmenter(words).cut if words else pairs

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(text: pd.Series) -> pd.Series:
        return text.map(cut)

    return lambda text: non_blank(tokens(F.coalesce(text, F.lit(""))))
