"""Request log while it grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gradeline import schemas
from gradeline.operators.audit import request_counts, with_url_flags


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST_LOG).json(path)


def request_totals(requests: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Requests per status, blocklist group and loopback flag, as a streaming aggregate."""
    return request_counts(with_url_flags(requests, groups))
