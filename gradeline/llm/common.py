"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeline.session import pin

#: Code points of text that one task turns into Arrow rows before it hands them on.
EMIT_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % parts


def sample_texts(docs: DataFrame, text: str, eligible: Column, most: int) -> DataFrame:
    """(text) of at most ``most`` distinct texts among the rows that are ``eligible``, NULL excepted.

    Those with the smallest hashes, so the choice hangs neither on layout nor on order. The hashes
    alone are ordered, and only the chosen texts move, each once however often it is repeated.
    """
    rows = docs.where(F.col(text).isNotNull() & eligible).select(F.col(text).alias("text"))
    hashes = pin(rows.select(F.xxhash64("text").alias("hash")).distinct(), "hashes")
    last = hashes.orderBy("hash").limit(most).agg(F.max("hash")).first()[0]
    chosen = rows.withColumn("hash", F.xxhash64("text"))
    chosen = chosen.where("false") if last is None else chosen.where(F.col("hash") <= last)
    return chosen.groupBy("hash").agg(F.min("text").alias("text")).select("text")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(
    df: DataFrame, schema: str, start: Callable[[], Callable[[list[list]], list[list]]]
) -> DataFrame:
    """Map rows to rows, column lists in and out, in slices of bounded text.

    ``start`` runs once per task (it loads the model) and returns the function from the columns of a
    slice of rows to the columns of the new rows. A slice ends after EMIT_CHARS code points, so a
    batch of very long texts is not held several times over.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            for part in slices(batch):
                columns = step([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = EMIT_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows that hold about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.ones(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)
