"""Sinks that can be restarted without repeating rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from gradeline.streaming.keyed import KeyedTable


def append_output(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Write what has arrived since the last run and stop; every input row is written once."""
    query = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Hand every micro-batch that is due to ``handle`` and stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_totals(aggregate: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> None:
    """Keep the rows of a streaming aggregate by its ``keys``: a micro-batch writes those it changed."""
    each_batch(aggregate, KeyedTable(path, keys).write, checkpoint, mode="update")


def read_totals(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows that ``write_totals`` keeps, as of the last micro-batch."""
    return KeyedTable(path, keys).current(spark)
