"""Batch results: triage, resend set, records, interrupted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.requests import prediction_text
from gradeline.operators.cost import MTOK, mtok_cost, with_usd_cost
from gradeline.functions.usage import with_usage


def triage(response: Column) -> Column:
    """The verdict on a result: 'keep', or the reason for asking once more.

    A reply stands if it came through with status 200 and was not cut at the token limit, with or
    without content. So does a 403 of the moderation, which would only come back.
    """
    status, body = response["status_code"], response["body"]
    flagged = F.map_contains_key(F.coalesce(body["error"]["metadata"], F.create_map().cast("map<string,string>")), F.lit("flagged_input"))
    finish = F.get(body["choices"], F.lit(0))["finish_reason"]
    return (
        F.when(response.isNull() | status.isNull(), "missing")
        .when((status == 403) & F.coalesce(flagged, F.lit(False)), "keep")
        .when(status != 200, "error")
        .when(finish == "length", "truncated")
        .otherwise("keep")
    )


def join_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with their result and its whole body, if any, and its verdict. Both keyed by ``idx``."""
    return requests.join(results.select("idx", "response", "raw"), "idx", "left").withColumn(
        "verdict", triage(F.col("response"))
    )


def to_resend(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict") != "keep")


def status_counts(judged: DataFrame) -> DataFrame:
    """Rows per verdict."""
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def build_records(
    answered: DataFrame, prices: DataFrame | None = None, model: str = "model", strict: bool = True
) -> DataFrame:
    """Prediction text, mtok and usd of each response (columns ``response`` and ``raw``, its JSON).

    Without a price table the model is local and its calls cost nothing. A response without usage
    costs nothing either; one whose usage cannot be read costs NULL, with ``usage_reason``. Billed
    columns: usage, usage_reason, mtok, usd, usd_error.
    """
    replied = answered.withColumn("pred", prediction_text(F.col("response"), F.col("raw")))
    if prices is None:
        return replied.withColumns({"mtok": F.lit(0).cast(MTOK), "usd": F.lit(0.0)})
    metered = with_usage(replied, "raw").withColumn("mtok", mtok_cost(F.col("usage")))
    billed = with_usd_cost(metered, prices, model=model, strict=strict)
    free = F.col("usage_reason").isin("usage missing", "empty body")
    return billed.withColumns(
        {
            "mtok": F.when(free, F.lit(0).cast(MTOK)).otherwise(F.col("mtok")),
            "usd": F.when(free, 0.0).otherwise(F.col("usd")),
        }
    )


def keep_every(df: DataFrame, k: int) -> DataFrame:
    """Every k-th record by index, for the raw log of a large run."""
    return df.where(F.col("idx") % k == 0)


def pending(dataset: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of an interrupted run that still lack a prediction, wherever the gaps are."""
    return dataset.join(done.select("idx"), "idx", "left_anti")


def resume_state(dataset: DataFrame, preds: DataFrame, raw: DataFrame) -> DataFrame:
    """Counts of an interrupted run and what is wrong with them (NULL if nothing); one row."""
    tagged = (
        dataset.select(F.lit("dataset").alias("part"))
        .unionAll(preds.select(F.lit("out").alias("part")))
        .unionAll(raw.select(F.lit("raw").alias("part")))
    )
    counts = tagged.agg(
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("dataset", "out", "raw")]
    )
    problem = F.when(F.col("n_out") != F.col("n_raw"), "out and raw differ").when(
        F.col("n_out") > F.col("n_dataset"), "more predictions than rows"
    )
    return counts.withColumn("problem", problem)
