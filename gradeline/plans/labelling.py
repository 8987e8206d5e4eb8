"""One reply per row of a sample: requests, local labelling, records, metrics."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from gradeline import schemas
from gradeline.functions.requests import request_body
from gradeline.functions.text import count_words
from gradeline.operators.batch import build_records, join_results, to_resend
from gradeline.operators.ledger import budget_cut
from gradeline.operators.report import metrics_document
from gradeline.operators.teacher import label_rows, local_response, window_fit
from gradeline.plans.tasks import TASKS
from gradeline.session import pin


def requests(
    questions: DataFrame, kind: str, slug: str, system: str, max_tokens: int, provider: str | None = None,
    thinking: str | None = None,
) -> DataFrame:
    """(idx, body): one request per question."""
    prompts = TASKS[kind].prompts(questions)
    pinned = F.lit(provider) if provider else None
    body = request_body(F.lit(slug), F.lit(system), F.col("prompt"), max_tokens, pinned, thinking=thinking)
    return prompts.select("idx", body.alias("body"))


def label_locally(
    questions: DataFrame,
    kind: str,
    make_predict: Callable[[], Callable],
    max_tokens: int,
    max_model_len: int,
    count: Callable[[Column], Column] = count_words,
) -> DataFrame:
    """(idx, response, raw, pred) from a supplied predictor; a prompt that does not fit is an error row."""
    prompts = window_fit(TASKS[kind].prompts(questions), F.col("prompt"), max_tokens, max_model_len, count)
    asked = prompts.withColumn("_asked", F.when(F.col("fits"), F.col("prompt")))
    labelled = label_rows(asked, "_asked", make_predict)
    document = local_response(F.col("pred"), F.col("error"), F.col("n_tokens"), count_words(F.coalesce("pred", F.lit(""))))
    answered = labelled.select("idx", document.alias("raw"))
    parsed = answered.withColumn("response", F.from_json("raw", schemas.RESPONSE))
    return parse_replies(build_records(parsed), kind)


def collect_batch(
    asked: DataFrame, results: DataFrame, kind: str, prices: DataFrame, model: str
) -> tuple[DataFrame, DataFrame]:
    """Records of the results worth keeping, and the requests to send again."""
    judged = join_results(asked, results)
    kept = judged.where("verdict = 'keep'").select(
        "idx", F.lit(model).alias("model"), F.col("response.body").alias("response"),
        "raw",
    )
    return parse_replies(build_records(kept, prices), kind), to_resend(judged).select("idx", "body")


def parse_replies(records: DataFrame, kind: str) -> DataFrame:
    """Apply the task's first-stage parser to replies; a response without one stays whole."""
    replied = F.get(F.col("response.choices"), F.lit(0))["message"]["content"].isNotNull()
    parsed = F.when(replied, TASKS[kind].parse_reply(F.col("pred"))).otherwise(F.col("pred"))
    return records.withColumn("pred", parsed)


def run_metrics(
    gold: DataFrame, records: DataFrame, kind: str, budget: float | Decimal | None = None,
    walltime: bool = True,
) -> DataFrame:
    """Metrics document of a run: scores, cost, wall time. Scores are left out when the budget cut it."""
    needed = [c for c in ("idx", "pred", "mtok", "usd", "walltime_min") if c in records.columns]
    kept = pin(budget_cut(pin(records.select(F.lit(0).alias("run"), *needed)), budget), "kept")
    totals = kept.agg(
        F.struct(F.sum("mtok").cast("double").alias("mtok"), F.sum("usd").alias("usd")).alias("cost"),
        *([F.sum("walltime_min").alias("walltime_min")] if walltime and "walltime_min" in kept.columns else []),
    )
    stopped = budget is not None and not kept.where("stopped_early").isEmpty()
    extra = {c: totals.select(c).scalar() for c in totals.columns}
    if stopped:
        return metrics_document(totals)
    return metrics_document(TASKS[kind].score(gold, kept.select("idx", "pred")), **extra)
