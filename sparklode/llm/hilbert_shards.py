"""Sharding along a Hilbert curve over several metadata dimensions.

Rows are quantised on language, source and length, ordered by their index on
the curve, and cut into runs of equal row count: each shard then covers small
boxes in all dimensions at once, so that file statistics prune on any of them.
Values of language and source lie on their axes in their sort order, each with
room by its frequency, so neighbouring cells hold neighbouring values. Equal
texts stand together, at the least place on the curve that any of them has.

The order is made by one range-partitioned sort of narrow rows (no texts); a
row's rank is its place within its partition plus the rows of the partitions
before it, so no task sees more than one partition.

Law ``rows``: the counts of shards differ by one at most. A group of equal texts
is cut only where it meets a border.

Edge cases: null texts have 16 bytes and crc 0 and are equal to empty ones; null
language or source is a value of its own. Texts of any length are read whole.
Repeated rows are all kept; equal rows take neighbouring places. An empty table
gives an empty result. Extra columns, whatever their names, are ignored by
``assign``; ``write_shards`` keeps all but one named ``shard``, which the shard's
number replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, text_of

#: Bits of each dimension on the curve.
BITS = 6
#: What a row takes besides its text.
ROW_BYTES = 16


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of integer points (n, dims), each below 2**bits.

    Gray-code walk from the highest bit: each level's cell is found in a frame
    that is reflected and permuted by the levels above it.
    """
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= carry
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    points = np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)
    return pd.Series(hilbert_index(points, BITS))


def bounds(docs: DataFrame, name: str) -> list[tuple[str, int]]:
    """The least value of each cell of an axis, with the cell from 1 on: at most 2**BITS - 1 runs of values in their order, cut by rows."""
    cells = (1 << BITS) - 1
    counts = docs.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    placed = stored(counts.repartitionByRange(name).sortWithinPartitions(name).withColumn("part", F.spark_partition_id()), "values")
    sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    before, total = _starts(sums)
    running = F.sum("n").over(Window.partitionBy("part").orderBy(name)) - F.col("n")
    cell = ((before + running) * cells / max(total, 1)).cast("int")
    found = placed.withColumn("cell", cell).groupBy("cell").agg(F.min(name).alias("least")).orderBy("cell").collect()
    discard(placed)
    return [(r["least"], r["cell"] + 1) for r in found]


def _starts(sums: dict[int, int]) -> tuple[Column, int]:
    """What lies before each partition (by column ``part``), and the whole."""
    starts, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        starts.append(F.lit(total).cast("long"))
        total += sums.get(part, 0)
    return (F.array(*starts)[F.col("part")] if starts else F.lit(0).cast("long")), total


def _cell(docs: DataFrame, name: str) -> Column:
    """A text value's place on its axis; 0 for null."""
    found = bounds(docs, name)
    least, cells = F.array(*[F.lit(b) for b, _ in found]).cast("array<string>"), F.array(*[F.lit(c) for _, c in found]).cast("array<long>")
    return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.get(cells, F.size(F.filter(least, lambda b: b <= F.col(name))) - 1)).cast("long")


def ordered(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve, the exact 0-based ``rank`` along the curve and the ``total`` of rows; ``carry``: also the whole ``row``."""
    more = ["row"] if carry else []
    docs = docs.select("doc_id", "text", "lang", "source", *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    text = text_of()
    size = F.octet_length(text).cast("long")
    log_size = F.least(F.floor(F.log2(size + 1.0) * 3), F.lit((1 << BITS) - 1)).cast("long")
    rows = docs.select(
        F.col("doc_id"),
        (size + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
        _cell(docs, "lang").alias("__a"),
        _cell(docs, "source").alias("__b"),
        log_size.alias("__c"), *more,
    ).select("doc_id", "size", "text_crc32", "same", _curve("__a", "__b", "__c").alias("curve"), *more)
    # Groups of equal texts, counted where they are read first; stored, so that the join is one of two plain tables, which Spark splits where a group is large.
    groups = rows.select("same", "curve").groupBy("same").agg(F.min("curve").alias("__least"), F.count("*").alias("__n")).where("__n > 1").select("same", "__least")
    rows = rows.join(stored(groups, "equal"), "same", "left").withColumn("curve", F.coalesce("__least", "curve")).drop("__least")
    keys = ["curve", "same", "text_crc32", "size", "doc_id"]
    placed = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "hilbert",
    )
    # One row per partition of the sort: a few thousand at most, whatever the rows.
    before, total = _starts({r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()})
    return placed.select("doc_id", "size", "text_crc32", "curve", (before + F.col("__place")).alias("rank"), F.lit(total).cast("long").alias("total"), *more)


def _cut(placed: DataFrame, n_shards: int) -> DataFrame:
    """Adds shard and slot: runs of the order whose counts differ by one at most."""
    shard = F.floor(F.expr(f"rank * {n_shards} DIV total")).cast("int")
    first = F.expr(f"(shard * total + {n_shards - 1}) DIV {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long"))


def assign(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null under this law), curve."""
    return _cut(ordered(docs), n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write the whole rows as Parquet, one folder ``shard=k`` each, in curve order."""
    rows = _cut(ordered(docs, carry=True), n_shards).select("row.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = rows.drop("shard").withColumnRenamed("__shard", "shard").repartition(n_shards, "shard").sortWithinPartitions("shard", "__slot")
    rows.drop("__slot").write.partitionBy("shard").parquet(path)
