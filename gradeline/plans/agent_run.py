"""Result of an agent run, from its tables only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from gradeline.operators.cost import with_usd_cost
from gradeline.operators.report import metrics_document
from gradeline.plans.tasks import TASKS
from gradeline.session import pin


def post_run(
    ledger_calls: DataFrame,
    prices: DataFrame,
    gold: DataFrame,
    preds: DataFrame | None,
    kind: str,
    run_info: Mapping[str, object] | None = None,
) -> DataFrame:
    """Cost and scores of one run, with ``run_info`` (return code, wall time and the like) added.

    ``ledger_calls``: model, usage, mtok of the billed calls. A call without a price is recorded as
    ``usd_error`` and a failed scoring as ``eval_error``; neither is raised.
    """
    priced = with_usd_cost(ledger_calls, prices, strict=False)
    cost = priced.agg(
        F.struct(
            F.coalesce(F.sum("mtok").cast("double"), F.lit(0.0)).alias("mtok"),
            F.when(F.count("usd_error") == 0, F.coalesce(F.sum("usd"), F.lit(0.0))).alias("usd"),
            F.min("usd_error").alias("usd_error"),
        ).alias("cost")
    )
    info = {name: F.lit(value) for name, value in (run_info or {}).items()}
    info["out_txt_exists"] = F.lit(preds is not None)
    if preds is None:
        return metrics_document(cost, **info)
    try:
        scores = pin(TASKS[kind].score(gold, preds), "scores")
    except Exception as error:  # the run's cost must be reported whatever its predictions are like
        if not isinstance(error, PySparkException) and "Py4J" not in type(error).__name__:
            raise
        reason = str(error).strip().splitlines()[0]
        return metrics_document(cost, **info, eval_error=F.lit(f"{type(error).__name__}: {reason}"))
    return metrics_document(scores, cost=cost.scalar(), **info)
