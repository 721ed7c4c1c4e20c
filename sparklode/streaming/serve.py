"""Micro-batch serving: queries arrive as a stream, each batch is one search job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers a stream of (query_id, text, ...) rows to Parquet files, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so
    every query is answered exactly once. ``once`` takes what is there and ends.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
