"""Incremental runs: a stream of documents through the batch operators, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import signals, windows


def run(documents: DataFrame, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Appends work(batch) of every micro-batch to Parquet under target; a batch that is run again replaces its own rows."""
    work = work or (lambda batch: signals.distances(windows.sliding_window(batch)))

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
