"""Raw teacher records to training and held-out rows, and the choice among sweep points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.text import count_words
from gradeline.operators.report import metrics_document
from gradeline.operators.sampling import holdout_split
from gradeline.operators.teacher import best_point, kept_rows, teacher_rows, training_rows, within_length


def training_sets(
    records: DataFrame,
    fraction: float = 0.1,
    seed: int = 0,
    max_length: int | None = None,
    count: Callable[[Column], Column] = count_words,
) -> DataFrame:
    """idx, prompt, completion, chat_template_kwargs and ``part`` (train or eval).

    ``max_length`` drops training rows whose turns together are longer; held-out rows stay.
    """
    rows = holdout_split(kept_rows(teacher_rows(records)), "idx", fraction, seed)
    if max_length is not None:
        whole = F.concat_ws("\n", "system", "user", "teacher")
        sized = within_length(rows.where("part = 'train'"), whole, max_length, count).drop("n_tokens")
        rows = sized.unionByName(rows.where("part = 'eval'"))
    return training_rows(rows)


def selection(sweep: DataFrame) -> DataFrame:
    """The selection document: the best point and every point in order, for a sweep of a handful of rows.

    For a large one take ``selection_summary`` and ``selection_rows``, which gather nothing.
    """
    points = F.array_sort(F.collect_list(F.struct("seq", "learning_rate", "eval_loss", "student_dir", "walltime_min")))
    return metrics_document(
        sweep.agg(points.alias("sweep")).withColumn("selected", best_point(sweep).select(F.struct("*")).scalar())
    )


def selection_summary(sweep: DataFrame) -> DataFrame:
    """The selection document without its points: the best one and how many there were."""
    return metrics_document(
        sweep.agg(F.count("*").alias("n_points")).withColumn("selected", best_point(sweep).select(F.struct("*")).scalar())
    )


def selection_rows(sweep: DataFrame) -> DataFrame:
    """Every point of the sweep as a row, with ``selected`` on the best; the table beside the document."""
    best = best_point(sweep).select("seq").scalar()
    return sweep.withColumn("selected", F.coalesce(F.col("seq") == best, F.lit(False)))
