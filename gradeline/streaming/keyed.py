"""The newest row of every key of a stream, kept in few files and without rewriting untouched keys.

A micro-batch adds the rows that it changed. The files of batch N cover as many batches, N the last,
as the largest power of two that divides N + 1: batches are merged like the carries of a binary
counter. A row is rewritten once for every doubling, reading takes at most a logarithm of the batches,
and what a file holds depends on batch numbers alone, so writing a batch again gives the same files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH = "_batch"


def cover(batches: int) -> list[int]:
    """The last batches of the files that together hold the first ``batches`` batches, newest first."""
    out = []
    while batches:
        out.append(batches - 1)
        batches &= batches - 1
    return out


class KeyedTable:
    """Rows by ``keys`` (NULL is a key) below ``root``/batch=N; a later batch's row replaces an earlier one's."""

    def __init__(self, root: str, keys: Sequence[str]):
        self.root, self.keys = root, list(keys)

    def _path(self, number: int) -> str:
        return f"{self.root}/batch={number}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row"))
        return newest.select(*self.keys, *[F.col("_row")[c].alias(c) for c in values])

    def _read(self, spark: SparkSession, numbers: Sequence[int]) -> DataFrame | None:
        if not numbers:
            return None
        return spark.read.parquet(*map(self._path, numbers))

    def before(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The newest rows of all batches before ``number``; None for the first."""
        held = self._read(spark, cover(number))
        return None if held is None else self._newest(held).drop(BATCH)

    def write(self, changed: DataFrame, number: int) -> None:
        """Add the rows that batch ``number`` changed, one a key, and drop files that no replay needs.

        Only this batch can still be repeated, so what it starts from is all that has to stay.
        """
        spark, needed = changed.sparkSession, cover(number)
        self._drop(spark, number, needed)
        span = (number + 1) & -(number + 1)
        rows = changed.withColumn(BATCH, F.lit(number).cast("bigint"))
        older = self._read(spark, [n for n in needed if n > number - span])
        if older is not None:
            rows = self._newest(rows.unionByName(older))
        rows.write.mode("overwrite").parquet(self._path(number))

    def _files(self, spark: SparkSession) -> tuple[object, list[tuple[int, object]]]:
        """The file system, and (batch, path) of the files."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(place):
            return files, []
        paths = [status.getPath() for status in files.listStatus(place)]
        return files, [(int(p.getName()[6:]), p) for p in paths if p.getName().startswith("batch=")]

    def _drop(self, spark: SparkSession, number: int, needed: Sequence[int]) -> None:
        files, found = self._files(spark)
        for batch, path in found:
            if batch < number and batch not in needed:
                files.delete(path, True)

    def current(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key after the last batch; an error before the first."""
        _, found = self._files(spark)
        if not found:
            raise ValueError(f"nothing has been written to {self.root}")
        return self.before(spark, max(batch for batch, _ in found) + 1)
