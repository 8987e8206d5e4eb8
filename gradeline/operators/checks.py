"""Expectations on counts. These act or raise; everything else reports errors as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """Raise unless ``df`` has exactly ``n`` rows."""
    found = df.count()
    if found != n:
        raise ValueError(f"expected {n:,} rows, found {found:,}")
    return df


def expect_at_least(df: DataFrame, num: int) -> DataFrame:
    """Raise when a sample asks for more rows than there are."""
    found = df.count()
    if num > found:
        raise ValueError(f"asked for {num} rows but there are {found}")
    return df


def count_guard(n_gold: Column, n_pred: Column, strict: bool) -> Column:
    """NULL when a prediction count is acceptable, else what is wrong.

    ``strict`` wants equality; otherwise there may be fewer predictions than gold rows, never more.
    """
    wrong = (n_gold != n_pred) if strict else (n_pred > n_gold)
    text = F.concat(n_pred.cast("string"), F.lit(" predictions for "), n_gold.cast("string"), F.lit(" rows"))
    return F.when(wrong, text)


def require(problem: Column, value: Column) -> Column:
    """``value``, or a raised error when ``problem`` is not NULL."""
    return F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(value)
