"""Extraction and relevance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions import replies
from gradeline.functions.text import normalize_answer
from gradeline.operators.checks import count_guard, require

OUTCOMES = ("a_a", "a_b", "a_n", "n_a", "n_n")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def align(gold: DataFrame, preds: DataFrame, pred: str = "pred") -> DataFrame:
    """Gold rows with their predictions, and predictions without a gold row (for the count guard).

    Adds ``_is_gold`` and ``_times``, how often the index was predicted. Predictions are grouped by
    index first, on the key the join needs anyway, so a repeated one adds no row. Of several the
    smallest is taken; the guard reports them.
    """
    left = gold.withColumn("_is_gold", F.lit(True))
    right = preds.groupBy("idx").agg(F.min(pred).alias(pred), F.count("*").alias("_times"))
    return left.join(right, "idx", "full_outer")


def _side_counts() -> list[Column]:
    return [
        F.count("_is_gold").alias("_n_gold"),
        F.coalesce(F.sum("_times"), F.lit(0)).alias("_n_pred"),
        F.count_if(F.col("_is_gold").isNull()).alias("_n_stray"),
        F.count_if(F.col("_times") > 1).alias("_n_twice"),
    ]


def _alignment_problem(strict: bool) -> Column:
    return F.coalesce(
        count_guard(F.col("_n_gold"), F.col("_n_pred"), strict),
        F.when(F.col("_n_stray") > 0, F.lit("predictions without a gold row")),
        F.when(F.col("_n_twice") > 0, F.lit("rows predicted more than once")),
    )


def alignment_report(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: n_gold, n_pred, n_stray, n_twice, and the problem under either rule, if any."""
    counts = align(gold.select("idx"), preds).agg(*_side_counts())
    return counts.select(
        *[F.col(f"_{n}").alias(n) for n in ("n_gold", "n_pred", "n_stray", "n_twice")],
        _alignment_problem(strict=False).alias("lenient"),
        _alignment_problem(strict=True).alias("strict"),
    )


def extraction_outcomes(rows: DataFrame) -> DataFrame:
    """Add ``outcome`` to rows with ``evidences`` and ``pred``; each side is normalised once."""
    staged = rows.withColumns(
        {
            "_gold": replies.gold_values(F.col("evidences")),
            "_guess": normalize_answer(replies.extraction_value(F.col("pred"))),
        }
    )
    outcome = replies.extraction_outcome(F.col("_gold"), F.col("_guess"))
    return staged.withColumn("outcome", outcome).drop("_gold", "_guess")


def score_extraction(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Outcome counts, precision, recall and F1, as one row.

    ``gold``: idx, evidences (array of struct with value); ``preds``: idx, pred (one per gold row).
    """
    measured = extraction_outcomes(align(gold.select("idx", "evidences"), preds)).withColumn(
        "_outcome", F.when(F.col("_is_gold") & F.col("_times").isNotNull(), F.col("outcome"))
    )
    counts = measured.agg(
        *[F.count_if(F.col("_outcome") == m).alias(m) for m in OUTCOMES], *_side_counts()
    )
    return counts.select(
        require(_alignment_problem(strict=True), F.col("_n_pred")).alias("n_scored"), *OUTCOMES
    ).select(*extraction_metrics(), "n_scored", *OUTCOMES)


def extraction_metrics() -> list[Column]:
    """Precision, recall and F1 from the outcome counts; each 0 where undefined."""
    right = F.col("a_a")
    predicted = F.col("n_a") + F.col("a_a") + F.col("a_b")
    stated = F.col("a_n") + F.col("a_a") + F.col("a_b")
    p, r = ratio(right, predicted), ratio(right, stated)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def relevance_predictions(gold: DataFrame, preds: DataFrame, seed: int = 0) -> DataFrame:
    """Gold label and predicted label per row; unusable or missing replies get the fallback letter."""
    joined = align(gold.select("idx", "example_id", "label"), preds)
    parsed = joined.withColumn("_letter", replies.relevance_letter(F.col("pred")))
    fallback = replies.fallback_letter(F.col("example_id"), seed)
    used = F.when(F.col("_letter") == "", fallback).otherwise(F.col("_letter"))
    return parsed.withColumn("predicted", replies.relevance_label(used)).select(
        "idx", "example_id", "label", "predicted", "_is_gold", "_times"
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Row counts per (label, predicted)."""
    return pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))


_SIDES = ("_n_gold", "_n_pred", "_n_stray", "_n_twice")


def f1_scores(confusion_counts: DataFrame) -> DataFrame:
    """Micro and macro F1 from (label, predicted, n); one row.

    Macro is the plain mean over the union of true and predicted classes, 0 for an undefined class.
    """
    return _f1(confusion_counts, ())


def _f1(counts: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    none = F.lit(0).cast("bigint")
    hits = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(none)

    def margin(name: str, n_true: Column, n_pred: Column, tp: Column, sides: list[Column]) -> Column:
        return F.struct(
            F.col(name).alias("name"), n_true.alias("n_true"), n_pred.alias("n_pred"), tp.alias("tp"),
            *[c.alias(s) for c, s in zip(sides, carried)],
        )

    margins = counts.select(
        F.explode(
            F.array(
                margin("label", F.col("n"), none, hits, [F.col(s) for s in carried]),
                margin("predicted", none, F.col("n"), none, [none for _ in carried]),
            )
        ).alias("m")
    ).select("m.*")
    summed = ("tp", "n_true", "n_pred", *carried)
    classes = margins.groupBy("name").agg(*[F.sum(c).alias(c) for c in summed])
    return classes.agg(
        ratio(F.sum("tp"), F.sum("n_true")).alias("micro_f1"),
        F.avg(ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))).alias("macro_f1"),
        F.sum("n_true").alias("n_scored"),
        *[F.sum(s).alias(s) for s in carried],
    )


def score_relevance(gold: DataFrame, preds: DataFrame, seed: int = 0) -> DataFrame:
    """Micro and macro F1, as one row. ``gold``: idx, example_id, label; ``preds``: idx, pred."""
    pairs = relevance_predictions(gold, preds, seed)
    # the side counts ride along with the confusion counts, so the join runs once
    counts = pairs.groupBy("label", "predicted").agg(F.count("_is_gold").alias("n"), *_side_counts())
    return _f1(counts, _SIDES).select(
        require(_alignment_problem(strict=False), F.col("micro_f1")).alias("micro_f1"),
        "macro_f1",
        "n_scored",
    )
