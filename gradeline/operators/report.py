"""Counters, leaderboards and metric documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Where each task keeps its primary metric.
METRIC_PATH = {
    "extraction": "$.f1",
    "relevance": "$.macro_f1",
    "detection": "$.score_agg.all.auroc",
}


def metrics_document(metrics: DataFrame, **extra: Column) -> DataFrame:
    """A one-row metrics frame as one JSON document; ``extra`` adds fields such as cost."""
    fields = [F.col(c) for c in metrics.columns]
    fields += [value.alias(name) for name, value in extra.items()]
    return metrics.select(F.to_json(F.struct(*fields)).alias("metrics"))


def long_metrics(metrics: DataFrame, run: str) -> DataFrame:
    """(run, metric, value) for every plain number of a one-row metrics frame."""
    numbers = [f.name for f in metrics.schema if f.dataType.typeName() in ("double", "long", "integer")]
    cast = metrics.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    return cast.unpivot([], numbers, "metric", "value").select(F.lit(run).alias("run"), "metric", "value")


def primary_metric(
    documents: DataFrame, paths: Mapping[str, str] = METRIC_PATH, task: str = "task", metrics: str = "metrics"
) -> DataFrame:
    """Add ``metric``: each run's primary number, found by its task's path; NULL if absent."""
    found = F.lit(None).cast("string")
    for name, where in paths.items():
        found = F.when(F.col(task) == name, F.get_json_object(F.col(metrics), where)).otherwise(found)
    return documents.withColumn("metric", found.try_cast("double"))


def normalized_gain(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``gain``: the metric as a share of the way from the trivial answer to the perfect one.

    ``limits``: task, trivial, perfect. NULL where the two coincide.
    """
    gain = F.try_divide(F.col("metric") - F.col("trivial"), F.col("perfect") - F.col("trivial"))
    return scores.join(limits, "task", "left").withColumn("gain", gain)
