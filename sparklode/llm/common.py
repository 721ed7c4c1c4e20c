"""Helpers shared by the operators: tables, shared storage, worker imports."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .wordhash import blocks


_stored: list[str] = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset (tests, one machine) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not _own:
        folder = tempfile.mkdtemp(prefix="sparklode-")
        _own.append("file://" + folder)
        atexit.register(shutil.rmtree, folder, True)
    return base or _own[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(lambda: spark.sparkContext._jsc and _clear(spark))
    _stored.append(path)
    return path


def append_stored(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to the table at ``path``."""
    df.write.option("compression", "zstd").mode("append").parquet(path)


def read_stored(spark: SparkSession, path: str, schema) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = [path]
    return out


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in a folder for each value of ``by``, and read back.

    Cuts the lineage: what is read again survives lost executors, and steps
    that must agree with each other read the same rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return read_stored(spark, path, df.schema)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in frames:
        for path in getattr(df, "stored_at", ()):
            if path in _stored:
                _stored.remove(path)
                _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear(spark: SparkSession) -> None:
    """Delete the stored tables of this process; they are only read within it."""
    for name in _stored:
        _delete(spark, name)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out(modulus: int, remainder: int, col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def least_hashes(rows: DataFrame, col: str, n: int, total: Column) -> DataFrame:
    """The rows among which the ``n`` with the smallest hash of ``col`` are, of ``total`` rows.

    A threshold leaves somewhat more than ``n`` rows, so that none but these are
    sorted or sent; hashes that are no even draw can leave fewer.
    """
    share = F.least(F.lit(1.0), F.lit(n + 10 * n**0.5 + 30) / F.greatest(total, F.lit(1.0)))
    return rows.where(F.xxhash64(col) / F.lit(2.0**64) + F.lit(0.5) <= share)


def kept_rows(docs: DataFrame, judge: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text (null as empty) is judged true.

    ``judge()`` is called once a task and gives the function from texts to
    booleans. No shuffle: batches are filtered where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for start, part in blocks(column):
                yield batch.slice(start, len(part)).filter(pa.array(keep(part)))

    return docs.mapInArrow(run, docs.schema)
