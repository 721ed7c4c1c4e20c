"""Text functions as column expressions; Python only where Spark has no builtin."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem

#: Default stop words of query analysis; any list can be given instead.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can did do does"
    " doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just"
    " me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their"
    " them then there these they this those through to too under until up very was we were what when where which while who why will"
    " with you your".split()
)


def _normaliser(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalise


nfkd, nfc = _normaliser("NFKD"), _normaliser("NFC")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    """Porter stems of token arrays; each different word is stemmed once a batch."""
    known: dict[str, str] = {}

    def one(word: str) -> str:
        if word not in known:
            known[word] = stem(word)
        return known[word]

    return tokens.map(lambda row: None if row is None else [one(w) for w in row])


def retrieval_text(comments: Column) -> Column:
    """All comment lines joined by a space; a null line keeps its separator."""
    return F.array_join(F.transform(comments, lambda x: F.coalesce(x, F.lit(""))), " ")


def non_blank(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike(r"(?U)^\s*$"))


def lexical_tokens(text: Column) -> Column:
    """Compatibility-decomposed, lower-cased runs of a-z and 0-9. Combining marks separate: an accented letter ends a token."""
    text = F.coalesce(text, F.lit(""))
    # Only texts beyond ASCII leave the JVM.
    apart = F.coalesce(nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    plain = F.trim(F.regexp_replace(F.lower(apart), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


#: Bytes of tokens, lower-cased; 0 separates.
_TOKEN = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _TOKEN[_c] = _TOKEN[ord(chr(_c).upper())] = _c


def lexical_lists(texts: pa.Array) -> pa.ListArray:
    """``lexical_tokens`` of a batch where it is in Python already; no token becomes an object."""
    plain = [b"" if t is None else (t if t.isascii() else unicodedata.normalize("NFKD", t)).encode() for t in texts.to_pylist()]
    data = _TOKEN[np.frombuffer(b"\0".join(plain) + b"\0", np.uint8)]
    inside = data > 0
    # The data begins as after a separator and ends with one.
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain)))
    lists = np.concatenate([[0], np.searchsorted(starts, stops)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), words)


def query_terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, stemming: bool = True) -> Column:
    """Punctuation to blanks, lower case, split, stop words out, then Porter stems."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\s]", " "))
    stops = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    kept = F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~F.array_contains(stops, t))
    return stem_all(kept) if stemming else kept


def leading_whitespace(line: Column) -> Column:
    return F.regexp_extract(line, r"(?U)^\s*", 0)


BRACE_LINE = r"(?U)^(\s*)\{\s*(.*?)\s*\}\s*$"


def brace_query(line: Column) -> Column:
    """The text in braces of a line that holds nothing else; null where there is none."""
    found = F.when(line.rlike(BRACE_LINE), F.trim(F.regexp_extract(line, BRACE_LINE, 2)))
    return F.when(found != "", found)
