"""Aligned views as tables bucketed and sorted by idx, which meet without being moved.

Questions, gold rows and predictions are joined by idx again and again: by every scoring, every merge,
every teacher row. Stored once by the hash of idx, equal buckets lie side by side from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket, which one task sorts (2.6 GB of texts of 10 kB), and the most buckets Spark allows.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 100_000


def view_buckets(rows: int) -> int:
    """Buckets for a table of so many rows. Views that are to meet need the same number."""
    return min(max(1, -(-rows // BUCKET_ROWS)), MOST_BUCKETS)


def store_view(view: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write a view (idx, ...) to ``path`` as ``table`` and return it as stored.

    Rows move once, by idx, and each task writes one bucket, so there are as many files as buckets.
    A NULL idx has a bucket too; repeated ones stay. An existing table or path is an error.
    """
    rows = view.withColumn("idx", F.col("idx").cast("bigint")).repartition(buckets, "idx")
    writer = rows.write.mode("error").format("parquet").option("path", path)
    writer.bucketBy(buckets, "idx").sortBy("idx").saveAsTable(table)
    return view.sparkSession.table(table)


def attach_view(spark: SparkSession, table: str, path: str, schema: str, buckets: int) -> DataFrame:
    """Name a stored view in a session whose catalog does not know it. ``schema`` without idx."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(f"idx BIGINT, {schema}"))
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (idx) SORTED BY (idx) "
        f"INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def store_views(views: dict[str, DataFrame], tag: str, out_dir: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """Store the views of a sample, by name, as tables ``<tag>_<name>`` below ``out_dir``; returns them.

    Without ``buckets`` the rows of the first view decide for all.
    """
    if buckets is None:
        buckets = view_buckets(next(iter(views.values())).count())
    return {name: store_view(v, f"{tag}_{name}", f"{out_dir}/{tag}_{name}", buckets) for name, v in views.items()}
