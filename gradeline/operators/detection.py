"""Detection scores: AUROC, thresholds at a false-positive rate, accuracy by slice.

Everything is worked out from one histogram (slice keys, score -> rows). Ranks come from prefix
sums over distinct scores, so neither a popular score nor a popular slice ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.replies import confidence, reply_number
from gradeline.operators.checks import require
from gradeline.operators.prefix import prefix_sums
from gradeline.operators.scoring import align
from gradeline.session import pin
from gradeline.sources.writers import write_document

HUMAN = "human"
ALL = "all"
AXES = ("domain", "model", "decoding", "repetition_penalty", "attack")
# The false-positive rates reported.
TARGET_FPRS = (0.05, 0.01)
NOTES = {
    "all": "no aggregate over all settings: some were not included",
    "no_adversarial": "no aggregate over all non-adversarial settings: some were not included",
}


def fpr_tag(target: float) -> str:
    """Column suffix of a target rate: 0.05 -> fpr_0_05."""
    return "fpr_" + f"{target:g}".replace(".", "_")


def score_rows(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Gold rows with a parsed score each; a missing or unusable prediction counts as chance.

    Raises when there are predictions that belong to no gold row, or several for one.
    """
    joined = align(gold, preds)
    stray = F.when(F.col("_is_gold").isNull(), F.lit("predictions without a gold row")).when(
        F.col("_times") > 1, F.lit("a row predicted more than once")
    )
    parsed = joined.withColumn("_number", reply_number(F.col("pred")))
    return parsed.withColumn("score", require(stray, confidence(F.col("_number")))).drop(
        "pred", "_number", "_is_gold", "_times"
    )


def results_by_id(df: DataFrame, results: DataFrame) -> DataFrame:
    """Attach external scores to gold rows by document id (both unique)."""
    return df.join(results.select("id", "score"), "id")


def histogram(scored: DataFrame) -> DataFrame:
    """Rows per slice and score, written once: all later steps read this instead of the rows.

    A NULL slice key counts as the empty string.
    """
    clean = [
        F.when(F.col(a) == ALL, F.raise_error(F.lit(f"{a} holds the reserved value '{ALL}'")))
        .otherwise(F.coalesce(F.col(a), F.lit("")))
        .alias(a)
        for a in AXES
    ]
    counts = scored.select(*clean, "score").groupBy(*AXES, "score").agg(F.count("*").alias("n"))
    return pin(counts, "histogram")


def human_ranks(hist: DataFrame) -> DataFrame:
    """Per scope (the literal 'all', or one domain) and score: its rows, and the human rows below.

    Columns scope, score, neg (human), pos (machine), neg_before. Every score seen on any row of
    the scope appears.
    """
    human = F.col("model") == HUMAN
    scoped = (
        hist.select(
            F.explode(F.array(F.lit(ALL), F.col("domain"))).alias("scope"),
            "score",
            F.when(human, F.col("n")).otherwise(0).cast("bigint").alias("neg"),
            F.when(human, 0).otherwise(F.col("n")).cast("bigint").alias("pos"),
        )
        .groupBy("scope", "score")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    )
    return pin(prefix_sums(scoped, {"neg_before": "neg"}, order_by=["score"], within=["scope"]), "ranks")


def scope_totals(ranks: DataFrame) -> DataFrame:
    """Human and machine rows per scope; written, so that joins know how small it is."""
    return pin(ranks.groupBy("scope").agg(F.sum("neg").alias("n_human"), F.sum("pos").alias("n_machine")), "totals")


def thresholds(ranks: DataFrame, totals: DataFrame, targets: Sequence[float] = TARGET_FPRS) -> DataFrame:
    """Per scope and target rate: the smallest score seen on any row that at most that share of the
    human rows reaches, and the share it gives. Infinite where no seen score will do; NULL where
    the scope has no human rows. One row per scope, columns threshold_<tag> and achieved_<tag>."""
    share = F.try_divide(
        (F.col("n_human") - F.col("neg_before")).cast("double"), F.col("n_human").cast("double")
    )
    found = []
    for target in targets:
        good = share <= target
        tag = fpr_tag(target)
        known = F.max("n_human") > 0
        found.append(
            F.when(known, F.coalesce(F.min(F.when(good, F.col("score"))), F.lit(float("inf"))))
            .alias(f"threshold_{tag}")
        )
        found.append(
            F.when(known, F.coalesce(F.max(F.when(good, share)), F.lit(0.0))).alias(f"achieved_{tag}")
        )
    return ranks.join(totals, "scope").groupBy("scope").agg(*found)


def _auroc(twice_u: Column, n_pos: Column, n_neg: Column) -> Column:
    return F.try_divide(
        twice_u.cast("double"), F.lit(2.0) * n_pos.cast("double") * n_neg.cast("double")
    )


def _twice_u(n: Column, below: Column, tied: Column) -> Column:
    """Twice the Mann-Whitney count of ``n`` machine rows at one score; exact, ties count half."""
    return n.cast("decimal(18,0)") * (2 * below + tied).cast("decimal(19,0)")


def auroc(ranks: DataFrame) -> DataFrame:
    """AUROC of machine against human rows, with the tallies; NULL if one side is empty. One row."""
    u = _twice_u(F.col("pos"), F.col("neg_before"), F.col("neg"))
    summed = ranks.where(F.col("scope") == ALL).agg(
        F.sum(u).alias("u"),
        F.sum(F.col("pos") + F.col("neg")).alias("n_scored"),
        F.count("*").alias("distinct_preds"),
        F.sum("neg").alias("n_human"),
        F.sum("pos").alias("n_machine"),
    )
    value = _auroc(F.col("u"), F.col("n_machine"), F.col("n_human"))
    return summed.select(value.alias("auroc"), "n_scored", "distinct_preds", "n_human", "n_machine")


def score_grid(
    hist: DataFrame,
    ranks: DataFrame,
    targets: Sequence[float] = TARGET_FPRS,
    per_domain_tuning: bool = False,
    totals: DataFrame | None = None,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Accuracy per target and AUROC for every cell of the five axes, each with an 'all' level.

    Cells hold machine rows; human rows enter through the threshold and as AUROC negatives, those
    of the cell's domain where the domain is fixed. The cube runs over per-slice sums, not rows.
    ``totals`` and ``limits`` are those of the ranks, if they are there already.
    """
    totals = scope_totals(ranks) if totals is None else totals
    limits = pin(thresholds(ranks, totals, targets), "limits") if limits is None else limits
    machine = hist.where(F.col("model") != HUMAN)
    overall = ranks.where(F.col("scope") == ALL).select(
        "score", F.col("neg").alias("neg_all"), F.col("neg_before").alias("below_all")
    )
    local = ranks.where(F.col("scope") != ALL).select(
        F.col("scope").alias("domain"), "score", F.col("neg").alias("neg_dom"), F.col("neg_before").alias("below_dom")
    )
    placed = machine.join(overall, "score").join(local, ["domain", "score"])
    if per_domain_tuning:
        placed = placed.join(limits.withColumnRenamed("scope", "domain"), "domain")
        limit = {t: F.col(f"threshold_{fpr_tag(t)}") for t in targets}
    else:
        one = limits.where(F.col("scope") == ALL)
        limit = {t: one.select(f"threshold_{fpr_tag(t)}").scalar() for t in targets}
    hits = [
        F.sum(F.when(F.col("score") >= limit[t], F.col("n")).otherwise(0)).alias(f"hits_{fpr_tag(t)}")
        for t in targets
    ]
    slices = placed.groupBy(*AXES).agg(
        F.sum("n").alias("n"),
        *hits,
        F.sum(_twice_u(F.col("n"), F.col("below_all"), F.col("neg_all"))).alias("u_all"),
        F.sum(_twice_u(F.col("n"), F.col("below_dom"), F.col("neg_dom"))).alias("u_dom"),
    )
    human = totals.select(F.col("scope"), F.col("n_human"))
    cells = slices.cube(*AXES).agg(
        *[F.grouping(a).alias(f"_g_{a}") for a in AXES],
        F.sum("n").alias("n_machine"),
        *[F.sum(f"hits_{fpr_tag(t)}").alias(f"hits_{fpr_tag(t)}") for t in targets],
        F.sum("u_all").alias("u_all"),
        F.sum("u_dom").alias("u_dom"),
    )
    named = cells.select(
        *[F.when(F.col(f"_g_{a}") == 1, ALL).otherwise(F.col(a)).alias(a) for a in AXES],
        "n_machine",
        *[f"hits_{fpr_tag(t)}" for t in targets],
        F.when(F.col("_g_domain") == 1, F.col("u_all")).otherwise(F.col("u_dom")).alias("u"),
    )
    return named.join(human, named["domain"] == human["scope"]).select(
        *AXES,
        "n_machine",
        *[
            (F.col(f"hits_{fpr_tag(t)}") / F.col("n_machine")).alias(f"accuracy_{fpr_tag(t)}")
            for t in targets
        ],
        _auroc(F.col("u"), F.col("n_machine"), F.col("n_human")).alias("auroc"),
    )


def headline(grid: DataFrame) -> DataFrame:
    """The two headline cells, 'all' and 'no_adversarial', with a note where a cell is absent."""
    free = [a for a in AXES if a != "attack"]
    wanted = F.col("attack").isin(ALL, "none")
    for a in free:
        wanted = wanted & (F.col(a) == ALL)
    spark = grid.sparkSession
    rows = [("all", ALL, NOTES["all"]), ("no_adversarial", "none", NOTES["no_adversarial"])]
    frame = spark.createDataFrame(rows, "headline STRING, attack STRING, _note STRING")
    metrics = [c for c in grid.columns if c not in AXES]
    found = grid.where(wanted).select("attack", *metrics)
    return frame.join(found, "attack", "left").select(
        "headline", *metrics, F.when(F.col("n_machine").isNull(), F.col("_note")).alias("note")
    )


def score_detection(gold: DataFrame, preds: DataFrame, auroc_only: bool = False) -> DataFrame:
    """All detection metrics of a run as one row with a nested ``score_agg``, like the other scorers."""
    return detection_scores(gold, preds, auroc_only)[0]


def detection_scores(
    gold: DataFrame, preds: DataFrame, auroc_only: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """The row of ``score_detection``, and the cells of the slice grid that it was read off.

    Without slices (``auroc_only``) there is no grid. It is written once, for both uses.
    """
    hist = histogram(score_rows(gold, preds))
    ranks = human_ranks(hist)
    tallies = auroc(ranks)
    if auroc_only:
        agg = F.struct(F.struct("auroc").alias("all"))
        only = tallies.select(
            agg.alias("score_agg"), F.lit(True).alias("auroc_only"), "n_scored", "distinct_preds", "n_human", "n_machine"
        )
        return only, None
    totals = scope_totals(ranks)
    every = pin(thresholds(ranks, totals), "limits")
    grid = pin(score_grid(hist, ranks, totals=totals, limits=every), "grid")
    rows = headline(grid)
    cell = F.struct(*[c for c in rows.columns if c != "headline"])
    both = rows.agg(
        F.struct(
            F.max(F.when(F.col("headline") == "all", cell)).alias("all"),
            F.max(F.when(F.col("headline") == "no_adversarial", cell)).alias("no_adversarial"),
        ).alias("score_agg")
    )
    limits = every.where(F.col("scope") == ALL).drop("scope")
    summary = tallies.drop("auroc").select(
        both.scalar().alias("score_agg"),
        "*",
        limits.select(F.struct("*")).scalar().alias("thresholds"),
        F.lit(False).alias("per_domain_tuning"),
    )
    return summary, grid


def write_detection_report(gold: DataFrame, preds: DataFrame, path: str) -> None:
    """The metrics document below ``path``/summary and the cells of its slice grid below ``path``/grid."""
    summary, grid = detection_scores(gold, preds)
    write_document(summary, f"{path}/summary")
    grid.write.parquet(f"{path}/grid")
