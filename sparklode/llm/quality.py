"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word bucket has a fixed sparse ternary index vector. A word's vector is
the sum of the index vectors of the words beside it over the whole corpus
(counted once per partition and added up slice by slice in a tree), plus its own. A
document is the mean and the spread of its words' vectors with a few moments of
its word distribution. The network's probabilities are calibrated by one
temperature, fitted on labelled rows that training hasn't seen.

Labels are learned from a bounded sample: ``SAMPLE`` rows of each class at most,
those with the smallest hash of doc_id among the rows that are not held out;
their probabilities are weighted back to the classes' shares. Word vectors cover
every document. Scoring reads every whole text, of any length, without a shuffle.

Edge cases: null and empty texts are documents without words and get the
network's answer to that; rows without a label are scored alike; repeated labels
of an id count once (the largest); rows are kept one for one, equal rows with
equal scores; columns beyond doc_id and text are passed through by ``keep`` and
ignored elsewhere, whatever their names; an empty table gives an empty result.
With labels of one class only the score is that class, without labels 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept_rows
from .toxicity import labelled
from .wordhash import KINDS, Batch, blocks, mix

SAMPLE = 6000
#: Every so many-th sampled row fits the temperature and not the network.
HELD_BACK = 4
#: Word buckets and vector width.
BUCKETS, WIDTH = 1 << 14, 32
#: Non-zero places of an index vector.
PLACES = 4
#: Words to each side that make up a word's context.
REACH = 2
HIDDEN = 32
SLICES = 16


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    h = mix(np.arange(BUCKETS * PLACES, dtype=np.uint64) + np.uint64(77))
    places = (h % np.uint64(WIDTH)).astype(np.int64).reshape(BUCKETS, PLACES)
    signs = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, PLACES)
    return places, signs


def shape_tokens(texts: list[bytes]) -> tuple[Batch, np.ndarray]:
    """Runs of letters, digits or other signs as written, and the bucket of each."""
    b = Batch(texts, KINDS, lower=False)
    return b, (b.hashes % np.uint64(BUCKETS)).astype(np.int64)


def contexts(texts: list[bytes], index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of neighbours' index vectors by word bucket."""
    b, bucket = shape_tokens(texts)
    places, signs = index
    owner = np.repeat(np.arange(len(texts)), b.count)
    out = np.zeros(BUCKETS * WIDTH)
    for step in range(1, REACH + 1):
        beside = owner[step:] == owner[:-step]
        left, right = bucket[:-step][beside], bucket[step:][beside]
        for word, other in ((left, right), (right, left)):
            for p in range(PLACES):
                out += np.bincount(word * WIDTH + places[other, p], weights=signs[other, p], minlength=BUCKETS * WIDTH)
    return out


def sum_matrices(parts: DataFrame, rows: int, width: int, slices: int) -> np.ndarray:
    """The sum of matrices that came as ``(slice, cells)`` rows; slices are added up apart from each other.

    A tree of two steps: with P partitions no task reads more than about the
    root of P rows. Cells are doubles, in which whole numbers stay whole.
    """
    size = rows // slices * width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                sums.setdefault(s, np.zeros(size))
                sums[s] += np.frombuffer(cells.as_buffer())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(np.zeros(len(sums), np.int32)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "branch", "cells"])

    schema = "slice int, branch int, cells binary"
    branches = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    some = parts.select("slice", F.pmod(F.spark_partition_id(), F.lit(branches)).alias("branch"), "cells")
    some = some.repartition(slices * branches, "slice", "branch").mapInArrow(add, schema)
    out = np.zeros((slices, size))
    # slices rows at most, of rows * width cells together, whatever the corpus
    for r in some.repartition(slices, "slice").mapInArrow(add, schema).collect():
        out[r["slice"]] += np.frombuffer(r["cells"])
    return out.reshape(rows, width)


def sliced(matrix: np.ndarray, slices: int) -> pa.RecordBatch:
    cut = matrix.astype(np.float64).reshape(slices, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "cells"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all word buckets, learned from every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            for _, part in blocks(batch.column(0)):
                total += contexts(part, index)
        if total.any():
            yield sliced(total, SLICES)

    found = sum_matrices(docs.select("text").mapInArrow(run, "slice int, cells binary"), BUCKETS, WIDTH, SLICES)
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, WIDTH))
    for p in range(PLACES):
        own[np.arange(BUCKETS), places[:, p]] += signs[:, p]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    # The common direction of all contexts says nothing about a word.
    return (unit(unit(found) - unit(found).mean(0)) + unit(own)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Each document's mean vector, spread, length and repetition."""
    b, bucket = shape_tokens(texts)
    out = np.zeros((len(texts), 2 * WIDTH + 4), np.float32)
    full = np.flatnonzero(b.count)
    if len(full):
        owner = np.repeat(np.arange(len(texts)), b.count)
        n = b.count[full, None]
        # Each document's word counts once, so that vectors are read once per different word.
        pair, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        row, word = pair // BUCKETS, pair % BUCKETS
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        v = vectors[word]
        mean = np.add.reduceat(v * times[:, None], first) / n
        out[full, :WIDTH] = mean
        out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(v * v * times[:, None], first) / n - mean * mean, 0))
        share = times / b.count[row]
        out[full, 2 * WIDTH] = np.log1p(b.count[full])
        out[full, 2 * WIDTH + 1] = np.add.reduceat(share * share, first)
        out[full, 2 * WIDTH + 2] = np.diff(np.append(first, len(row))) / b.count[full]
        length = np.concatenate([[0], np.cumsum(b.ends - b.starts)])
        out[full, 2 * WIDTH + 3] = np.log((length[b.first + b.count] - length[b.first])[full] / b.count[full])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Weights of the two layers by Adam on the weighted log loss."""
    rng = np.random.default_rng(7)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb, cb = x[rows], y[rows], weight[rows]
            h = np.tanh(xb @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = cb * (p - yb) / len(rows)
            dh = np.outer(d, w[2]) * (1 - h * h)
            slopes = [xb.T @ dh + decay * w[0], dh.sum(0), h.T @ d + decay * w[2], d.sum()]
            t += 1
            for k, g in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def temperature_of(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least weighted log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    loss = [(weight * np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def feature_rows(rows: DataFrame, vectors: np.ndarray, label: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in blocks(batch.column(0)):
                x = pooled(shared.value, part)
                own = [batch.column(i).slice(start, len(part)) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *own], names=["x", "y", "place", "weight"])

    return rows.select("text", label, "place", "weight").mapInArrow(run, "x binary, y int, place int, weight double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Vectors from all documents, the network from most of the sample, the temperature from the rest."""
    vectors = word_vectors(docs)
    found = feature_rows(labelled(docs, labels, label, sample, HELD_BACK), vectors, label).toPandas()
    width = 2 * WIDTH + 4
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(len(found), width).astype(float)
    return fit_network(vectors, x, found["y"].to_numpy(float), found["place"].to_numpy(), found["weight"].to_numpy(float))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray, weight: np.ndarray) -> Model:
    width = x.shape[1]
    model = Model(vectors, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())))
    if not len(y) or y.min() == y.max():
        model.shift = 0.0 if not len(y) else 30.0 if y[0] else -30.0
        return model
    order = np.lexsort((place, *x.T[:4]))  # rows come in any order; training must not depend on it
    x, y, place, weight = x[order], y[order], place[order], weight[order] / weight.mean()
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-3
    learn = place > 0
    if not 0 < y[learn].mean() < 1:
        learn[:] = True
    model.layers = train((x[learn] - model.centre) / model.scale, y[learn], weight[learn])
    rest = ~learn
    if rest.any():
        model.temperature = temperature_of(model.logits(x[rest]), y[rest], weight[rest])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in blocks(batch.column(2)):
                s = shared.value.probability(pooled(shared.value.vectors, part)).astype(float)
                own = [batch.column(i).slice(start, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(5, 0).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score is ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda: lambda texts: shared.value.probability(pooled(shared.value.vectors, texts)) >= threshold)
