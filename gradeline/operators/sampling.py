"""Seeded order, samples, held-out splits, aligned views and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.functions.replies import fallback_letter

# The digest is uniform, so 16 bits of it cut any table into at most 65,536 even buckets: about
# 1.5 GB each for 100 TB, which one task sorts with spilling, and a table of starts of a few MB.
_HEX_DIGITS = 4


def seeded_digest(key: Column, seed: int) -> Column:
    """The sort key of the seeded shuffle: reproducible, uniform, independent of partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _bucketed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_digest", seeded_digest(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_digest", 1, _HEX_DIGITS)
    )


def _bucket_starts(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows before and in each digest bucket; at most 65,536 rows, whatever the table's size."""
    counts = _bucketed(df.select(key), key, seed).groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def seeded_order(df: DataFrame, key: str, seed: int, num: int | None = None) -> DataFrame:
    """Shuffle by seed and keep the first ``num`` rows (all if None); adds ``idx`` from 0.

    Buckets wholly beyond ``num`` are dropped before any row is shuffled. ``key`` must be unique.
    """
    starts = _bucket_starts(df, key, seed)
    if num is not None:
        starts = starts.where(F.col("_start") < num)
    placed = Window.partitionBy("_bucket").orderBy("_digest", key)
    ranked = (
        _bucketed(df, key, seed)
        .join(F.broadcast(starts), "_bucket")
        .withColumn("idx", F.col("_start") + F.row_number().over(placed) - 1)
    )
    if num is not None:
        ranked = ranked.where(F.col("idx") < num)
    return ranked.drop("_digest", "_bucket", "_start", "_size")


def holdout_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Add ``part``: the first floor(n * fraction) rows of the seeded shuffle are 'eval', the rest
    'train'.

    Only the last held-out row has to be found; every row is then compared with it in place.
    """
    starts = _bucket_starts(df, key, seed)
    sized = starts.withColumn(
        "_quota", F.floor(F.sum("_size").over(Window.partitionBy()) * F.lit(fraction))
    )
    edge = sized.where((F.col("_start") < F.col("_quota")) & (F.col("_quota") <= F.col("_start") + F.col("_size")))
    placed = Window.partitionBy("_bucket").orderBy("_digest", key)
    last = (
        _bucketed(df.select(key), key, seed)
        .join(F.broadcast(edge), "_bucket")
        .withColumn("_rank", F.col("_start") + F.row_number().over(placed))
        .where(F.col("_rank") == F.col("_quota"))
        .select(F.struct("_digest", F.col(key).alias("_key")).alias("_last"))
    )
    # one row by construction: a scalar subquery, not a join over data
    edge_digest, edge_key = (last.select(f"_last.{c}").scalar() for c in ("_digest", "_key"))
    digest = F.col("_digest")
    held = (digest < edge_digest) | ((digest == edge_digest) & (F.col(key) <= edge_key))
    return (
        df.withColumn("_digest", seeded_digest(F.col(key), seed))
        .withColumn("part", F.when(held, "eval").otherwise("train"))
        .drop("_digest")
    )


def views(
    sample: DataFrame, question_fields: Sequence[str], gold_fields: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Question view and gold view of a sample, both keyed by ``idx``.

    Without ``gold_fields`` the gold side is every column the question side does not show.
    """
    if gold_fields is None:
        gold_fields = [c for c in sample.columns if c not in (*question_fields, "idx")]
    return sample.select("idx", *question_fields), sample.select("idx", *gold_fields)


def merge_views(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """One record per index; a gold column wins over a question column of the same name."""
    shared = [c for c in questions.columns if c in gold.columns and c != "idx"]
    return questions.drop(*shared).join(gold, "idx")


def keep_sampled(source: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is in the sample."""
    return source.join(sampled.select(key), key, "left_semi")


def lift_single_attribute(df: DataFrame) -> DataFrame:
    """Rows with exactly one attribute: its key and evidences become columns."""
    checked = F.when(F.size("attributes") == 1, F.get(F.col("attributes"), F.lit(0))).otherwise(
        F.raise_error(F.lit("expected exactly one attribute"))
    )
    return (
        df.withColumn("_one", checked)
        .withColumns({"attribute": F.col("_one.key"), "evidences": F.col("_one.evidences")})
        .drop("_one", "attributes")
    )


def first_wins(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], copies: str | None = None) -> DataFrame:
    """The first row of every key in the given order, which must order the rows of a key totally.

    The smallest place per key is an aggregate over places only: copies shrink to one row per task
    before the shuffle, so a key that holds a third of the table costs no more than any other. The
    rows are then kept by key and place, NULLs in either being equal; the columns themselves are the
    join keys, so a row moves without a second copy of them. ``copies`` names a column to be added:
    how many rows had the key, which the same aggregate counts.
    """
    marks = [f"_first_{i}" for i in range(len(keys) + len(order_by))]
    found = [F.min(F.struct(*order_by)).alias("_place"), *([F.count("*").alias(copies)] if copies else [])]
    first = df.groupBy(*keys).agg(*found)
    place = [F.col("_place")[c].alias(mark) for c, mark in zip(order_by, marks[len(keys) :])]
    counted = [copies] if copies else []
    first = first.select(*[F.col(k).alias(mark) for k, mark in zip(keys, marks)], *place, *counted)
    same = [F.col(c).eqNullSafe(F.col(mark)) for c, mark in zip((*keys, *order_by), marks)]
    if copies is None:
        return df.join(first, reduce(and_, same), "left_semi")
    return df.join(first, reduce(and_, same)).drop(*marks)


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows read, kept and dropped by ``first_wins``."""
    per_key = df.groupBy(*[F.col(k) for k in keys]).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_read"),
        F.count("*").alias("n_kept"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_dropped"),
    )


def fallback_labels(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The persisted form of the fallback: one letter per key."""
    return df.select(key, fallback_letter(F.col(key), seed).alias("letter"))


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows by index, for a report."""
    return df.orderBy("idx").limit(n)
