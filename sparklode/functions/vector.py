"""Vector arithmetic and chunk windows over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEN, OVERLAP, PAD_ID = 512, 50, 0


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over its norm; NaN throughout where the norm is 0."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n))


def mean_pool(vectors: Column, mask: Column, width: int) -> Column:
    """Mean of the vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"])
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: F.try_divide(x, F.size(kept).cast("double")))


def chunk_starts(n: Column, size: int = MAX_LEN, overlap: int = OVERLAP) -> Column:
    """Offsets of sliding windows over n tokens; none for no tokens, the last window reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(float(step))), F.lit(0)).cast("int") * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunks(ids: Column, size: int = MAX_LEN, overlap: int = OVERLAP) -> Column:
    return F.transform(chunk_starts(F.size(ids), size, overlap), lambda i: F.slice(ids, i + 1, size))


def padded(ids: Column, size: int = MAX_LEN, pad: int = PAD_ID) -> Column:
    """The first ``size`` ids, filled up on the right."""
    cut = F.slice(ids, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(size) - F.size(cut)))


def attention_mask(ids: Column, size: int = MAX_LEN) -> Column:
    """1 for each of the first ``size`` ids, 0 for the filling."""
    n = F.least(F.size(ids), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))
