"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes, its end padded. Filters of
several widths run over the byte embeddings of a window, each keeps its largest
value, and a softmax over the languages follows; a text's answer is the mean of
its windows by length. Trained in numpy on windows of labelled texts.

A filter of width w is a sum of w tables indexed by byte (embedding times
weight), so scoring adds up table rows; two bytes' tables are merged into one
of 65,536 rows.

Learned from a bounded sample: of every language the ``PER_LANGUAGE`` rows with
the smallest hash of doc_id that are not held out (fewer, where there are so
many languages that these are more than ``ROWS``, but ``LEAST`` at least),
``PER_TEXT`` windows of each. Scoring reads every whole text, of any length, in
Arrow batches, without a shuffle.

Edge cases: a text that is null or has no letter is ``und`` with score 0, also
where there is nothing to learn from; with one language all others are it; of
equally probable languages the first by name is given; rows are kept one for
one, equal rows with equal answers; columns beyond doc_id, text and lang are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, least_hashes
from .wordhash import blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
PER_LANGUAGE, LEAST, ROWS, PER_TEXT = 800, 8, 160_000, 3
#: Tables of up to so many languages are broadcast.
BROADCAST = 100_000

_ascii_letter = np.zeros(256, bool)
_ascii_letter[[*range(65, 91), *range(97, 123)]] = True
_letter = regex.compile(r"\p{L}").search


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes, each window's text, and its bytes without padding."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    data = np.frombuffer(b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return data, owner, np.minimum(WINDOW, length[owner] - place * WINDOW)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Of each width, for each place of the filter, the 256 rows that its byte adds."""
        return [[(self.embedding @ k[j]).astype(np.float32) for j in range(len(k))] for k in self.filters]

    def paired(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """The tables merged for two bytes at a time: (first two bytes, the rest of the filter)."""
        out = []
        for t in self.tables():
            head = (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS)
            tail = None if len(t) == 2 else t[2] if len(t) == 3 else (t[2][:, None, :] + t[3][None, :, :]).reshape(65536, FILTERS)
            out.append((head, tail))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.bias


def pool(paired: list[tuple[np.ndarray, np.ndarray | None]], data: np.ndarray, rows: int = 512) -> np.ndarray:
    """Each filter's largest value in each window."""
    out = np.empty((len(data), FILTERS * len(paired)), np.float32)
    for at in range(0, len(data), rows):
        d = data[at : at + rows].astype(np.int32)
        two = d[:, :-1] << 8 | d[:, 1:]
        for i, (head, tail) in enumerate(paired):
            w = WIDTHS[i]
            n = WINDOW - w + 1
            value = head[two[:, :n]]
            if tail is not None:
                value += tail[(d if w == 3 else two)[:, 2 : 2 + n]]
            out[at : at + rows, i * FILTERS : (i + 1) * FILTERS] = value.max(axis=1)
    return out


def train(data: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 5, batch: int = 64, rate: float = 5e-3) -> Network:
    """Adam on the log loss; only the windows' largest places carry slopes back to the tables."""
    rng = np.random.default_rng(11)
    net = Network(
        languages, rng.normal(0, 1, (256, EMBEDDING)), [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages)),
    )
    params = [net.embedding, *net.filters, net.out, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for at in range(0, len(data), batch):
            rows = order[at : at + batch]
            d, target, n = data[rows].astype(np.int64), y[rows], len(rows)
            tables, best, where = net.tables(), [], []
            for t, w in zip(tables, WIDTHS, strict=True):
                size = WINDOW - w + 1
                value = sum(t[j][d[:, j : j + size]] for j in range(w))
                where.append(value.argmax(1))
                best.append(np.take_along_axis(value, where[-1][:, None, :], 1)[:, 0])
            pooled = np.hstack(best)
            z = net.logits(pooled)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), target] -= 1
            p /= n
            back = (p @ net.out.T) * (pooled > 0)
            slope_embedding, slope_filters = np.zeros_like(net.embedding), []
            for i, (k, w) in enumerate(zip(net.filters, WIDTHS, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                slope = np.zeros_like(k)
                for j in range(w):
                    byte = np.take_along_axis(d, where[i] + j, 1)
                    cell = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                    slope[j] = net.embedding.T @ cell
                    slope_embedding += cell @ k[j].T
                slope_filters.append(slope)
            slopes = [slope_embedding, *slope_filters, np.maximum(pooled, 0).T @ p, p.sum(0)]
            step += 1
            for q, g, a, b in zip(params, slopes, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def sample_windows(docs: DataFrame) -> DataFrame:
    """lang and ``window`` of some windows of the sampled rows."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2))
    counts = usable.groupBy("lang").agg(F.count("*").cast("double").alias("__total"))
    languages = counts.count()
    each = min(PER_LANGUAGE, max(LEAST, ROWS // max(1, languages)))
    counts = F.broadcast(counts) if languages <= BROADCAST else counts
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # The threshold leaves little more of any language than is taken.
    few = least_hashes(usable.select("lang", "doc_id").join(counts, "lang"), "doc_id", each, F.col("__total"))
    chosen = few.withColumn("__place", place).where(F.col("__place") <= each).select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            names = batch.column(1).to_pylist()
            for start, part in blocks(batch.column(0)):
                data, owner, size = windows(part)
                for i in range(len(part)):
                    own = np.flatnonzero((owner == i) & ((size >= WINDOW // 4) | (owner != np.roll(owner, 1))))
                    for k in own[np.linspace(0, len(own) - 1, min(PER_TEXT, len(own))).astype(int)] if len(own) else ():
                        langs.append(names[start + i])
                        out.append(data[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    # ROWS ids at most, or LEAST of each language
    rows = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang")
    return rows.mapInArrow(run, "lang string, window binary")


def fit(docs: DataFrame) -> Network | None:
    """The network, or None where there is nothing to learn from."""
    found = sample_windows(docs).toPandas().sort_values(["lang", "window"], kind="stable")
    if not len(found):
        return None
    languages = sorted(found["lang"].unique())
    data = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, WINDOW)
    return train(data, np.searchsorted(languages, found["lang"]), languages)


def has_letter(text: bytes) -> bool:
    data = np.frombuffer(text, np.uint8)
    return bool(_ascii_letter[data].any() or (data > 127).any() and _letter(text.decode(errors="replace")))


def predict(net: Network | None, paired: list, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The language and its probability of each text."""
    lettered = np.fromiter(map(has_letter, texts), bool, len(texts))
    score, name = np.zeros(len(texts)), ["und"] * len(texts)
    if net is None or not lettered.any():
        return name, score
    data, owner, size = windows(texts)
    z = net.logits(pool(paired, data))
    p = np.exp(z - z.max(1, keepdims=True))
    p *= (size / p.sum(1))[:, None]
    total = np.stack([np.bincount(owner, weights=p[:, k], minlength=len(texts)) for k in range(p.shape[1])], 1)
    total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
    best = total.argmax(1)
    for i in np.flatnonzero(lettered):
        name[i] = net.languages[best[i]]
        score[i] = min(1.0, total[i, best[i]])
    return name, score


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        paired = net.paired() if net else []
        for batch in batches:
            for start, part in blocks(batch.column(2)):
                name, score = predict(net, paired, part)
                own = [batch.column(i).slice(start, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )
