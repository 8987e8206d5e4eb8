"""Spend over a sequence of calls: balances, budget cuts, time budgets."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.operators.cost import MTOK
from gradeline.operators.prefix import BLOCK, idx_block, prefix_sums, sums_over_blocks


def _money(value: float | str | Decimal) -> Column:
    return F.lit(Decimal(str(value))).cast(MTOK)


def running_ledger(
    calls: DataFrame,
    budget: float | str | Decimal,
    order_by: Sequence[str],
    run: str = "run",
    cost: str = "mtok",
    opening: DataFrame | None = None,
) -> DataFrame:
    """Balance of the run before and after every call, what remains, and whether it is used up.

    ``order_by`` must be unique within a run. An unbilled call has a NULL cost and changes nothing.
    Calls without a run are a run. Rows are written before they are ordered: leave the bodies behind.
    ``opening`` (run, opening) carries balances over from earlier calls, one row per run.
    """
    paid = calls.withColumn("_paid", F.coalesce(F.col(cost).cast(MTOK), _money(0)))
    if opening is not None:
        opening = opening.select(run, F.col("opening").alias("spent_before"))
    summed = prefix_sums(paid, {"spent_before": "_paid"}, order_by, within=[run], as_type=MTOK, opening=opening)
    before = F.col("spent_before")
    after = (before + F.col("_paid")).cast(MTOK)
    return summed.withColumns(
        {
            "spent_after": after,
            "remaining": (_money(budget) - after).cast(MTOK),
            "exhausted": after >= _money(budget),
        }
    ).drop("_paid")


def first_exhausted(ledger: DataFrame, budget: float | str | Decimal, run: str = "run") -> DataFrame:
    """The call that used up each run's budget: costs are never negative, so there is at most one."""
    limit = _money(budget)
    return ledger.where((F.col("spent_before") < limit) & (F.col("spent_after") >= limit))


def budget_cut(
    records: DataFrame,
    budget: float | str | Decimal | None,
    run: str = "run",
    cost: str = "mtok",
    initial: float | str | Decimal = 0,
) -> DataFrame:
    """Records kept when a run stops after the one that reaches the budget.

    ``idx`` is the row's position in its run. ``initial`` is what earlier attempts spent. Blocks of
    a run that start past the budget never enter the window. Adds spent_after and stopped_early
    (true on the record that reached the budget); no budget keeps everything.
    """
    paid = records.withColumn("_paid", F.coalesce(F.col(cost).cast(MTOK), _money(0))).withColumn(
        BLOCK, idx_block(F.col("idx"))
    )
    still_open = None if budget is None else F.col("_base__before") + _money(initial) < _money(budget)
    summed = sums_over_blocks(paid, {"_before": "_paid"}, ["idx"], within=[run], as_type=MTOK, keep=still_open)
    before = F.col("_before") + _money(initial)
    after = (before + F.col("_paid")).cast(MTOK)
    kept = summed if budget is None else summed.where(before < _money(budget))
    stopped = F.lit(False) if budget is None else after >= _money(budget)
    return kept.withColumns({"spent_after": after, "stopped_early": stopped}).drop("_paid", "_before", BLOCK)


def budget_status(calls: DataFrame, budget: float | str | Decimal, run: str = "run", cost: str = "mtok") -> DataFrame:
    """Spent, budget and remaining per run."""
    spent = F.coalesce(F.sum(F.col(cost).cast(MTOK)), _money(0)).cast(MTOK)
    return calls.groupBy(run).agg(spent.alias("spent_mtok")).select(
        run,
        "spent_mtok",
        _money(budget).alias("budget_mtok"),
        (_money(budget) - F.col("spent_mtok")).cast(MTOK).alias("remaining_mtok"),
        (F.col("spent_mtok") >= _money(budget)).alias("exhausted"),
    )


def time_status(calls: DataFrame, budget_min: float, time: str = "time", run: str = "run") -> DataFrame:
    """Minutes used and left per run, from the first and last epoch second logged."""
    used = (F.max(time) - F.min(time)) / F.lit(60.0)
    return calls.groupBy(run).agg(used.alias("used_time_min")).select(
        run,
        F.lit(float(budget_min)).alias("total_time_budget_min"),
        "used_time_min",
        (F.lit(float(budget_min)) - F.col("used_time_min")).alias("remaining_time_min"),
    )
