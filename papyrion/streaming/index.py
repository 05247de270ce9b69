"""The index as a stream: documents arrive, events are folded by micro-batch."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks


def stream_table(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in micro-batches, then stop; restarts go on where the checkpoint ends."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folded(stream: DataFrame, event_time: str | None = None, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Running counts of each document's events, for update mode.

    With an event time, events of a document belong together until nothing comes for ``gap``; what is
    later than ``delay`` is dropped, and with it the state of what has ended, so state does not grow for ever.
    """
    if event_time is None:
        return chunks.fold_events(stream)
    return chunks.fold_events(stream.withWatermark(event_time, delay), F.session_window(event_time, gap).alias("session"))


@contextlib.contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry ``tag``, so that ``cancel`` from another thread ends them with an error here."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """End all running jobs that carry ``tag``."""
    return spark.interruptTag(tag)
