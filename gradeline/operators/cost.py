"""Token usage to weighted units and money."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.usage import COUNTER_RATES, COUNTERS

# Weight of each counter in the budget unit.
MTOK_WEIGHTS = {
    "input_tokens": Decimal("1.0"),
    "output_tokens": Decimal("2.0"),
    "cache_creation_input_tokens": Decimal("1.0"),
    "cache_read_input_tokens": Decimal("0.1"),
}
# Room for 19 digits before the point. A wider type would lose decimals: Spark cuts the scale of a
# sum that no longer fits 38 digits.
MTOK = "decimal(28,9)"


def weights_of(table: DataFrame) -> dict[str, Decimal]:
    """The weight table (one row per counter) as a mapping; unknown counters are an error."""
    rows = table.select("counter", "weight").limit(len(COUNTERS) + 1).collect()
    weights = {r["counter"]: Decimal(str(r["weight"])) for r in rows}
    if len(rows) != len(weights) or not set(weights) <= set(COUNTERS):
        raise ValueError(f"weights must name each of {COUNTERS} at most once, got {sorted(weights)}")
    return weights


def mtok_cost(usage: Column, weights: Mapping[str, Decimal] = MTOK_WEIGHTS) -> Column:
    """Weighted millions of tokens, exact: running sums meet a budget at the right row."""
    total = None
    for counter, weight in weights.items():
        part = usage[counter].cast("decimal(18,0)") * F.lit(weight).cast("decimal(6,3)")
        total = part if total is None else total + part
    return (total * F.lit(Decimal("0.000001"))).cast(MTOK)


def rates_long(prices: DataFrame) -> DataFrame:
    """Price table as (model, rate, usd_per_mtok); a blank cell means no such rate and is left out."""
    rates = [c for c in prices.columns if c not in ("model", "tag")]
    return (
        prices.unpivot("model", [F.col(f"`{c}`") for c in rates], "rate", "usd_per_mtok")
        .where(F.col("usd_per_mtok").isNotNull())
    )


def merge_prices(*tables: DataFrame) -> DataFrame:
    """All price tables as one; a model priced twice is an error."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    twice = merged.groupBy("model").agg(F.count("*").alias("n")).where("n > 1").select("model")
    clash = sorted(r["model"] or "NULL" for r in twice.collect())
    if clash:
        raise ValueError(f"priced in more than one table: {clash}")
    return merged


def with_usd_cost(
    df: DataFrame, prices: DataFrame, usage: str = "usage", model: str = "model", strict: bool = True
) -> DataFrame:
    """Add ``usd`` and ``usd_error``.

    A missing rate is fine while its counter is 0. Otherwise, and for an unpriced model, ``strict``
    raises; without it the row gets NULL and the reason. One equi-join on the model, no regrouping.
    """
    rates = prices.select(
        F.col("model").alias("_model"), *[F.col(f"`{r}`").alias(f"_{r}") for r in COUNTER_RATES.values()]
    )
    joined = df.join(rates, F.col(model) == F.col("_model"), "left")
    error = F.when(F.col(usage).isNull(), F.lit(None).cast("string")).when(
        F.col("_model").isNull(), F.concat(F.lit("no rates for model "), F.coalesce(F.col(model), F.lit("NULL")))
    )
    total = F.lit(0.0)
    for counter, rate in COUNTER_RATES.items():
        tokens = F.col(usage)[counter]
        lacking = F.col(f"`_{rate}`").isNull() & (tokens > 0)
        error = error.when(lacking, F.concat(F.col(model), F.lit(f": {counter} without {rate}")))
        total = total + F.when(F.col(f"`_{rate}`").isNull(), 0.0).otherwise(tokens * F.col(f"`_{rate}`"))
    usd = F.when(error.isNull() & F.col(usage).isNotNull(), total / F.lit(1e6))
    if strict:
        usd = F.when(error.isNotNull(), F.raise_error(error)).otherwise(usd)
    return joined.withColumn("usd_error", error).withColumn("usd", usd).drop(
        "_model", *[f"_{r}" for r in COUNTER_RATES.values()]
    )


def run_totals(calls: DataFrame, run: str = "run", local: bool = False) -> DataFrame:
    """Total mtok, usd and wall time per run; one failed row makes usd NULL and records why.

    Local runs keep only some of their records, so they get no wall time.
    """
    aggs = [
        F.sum("mtok").alias("mtok"),
        F.when(F.count("usd_error") == 0, F.sum("usd")).alias("usd"),
        F.min("usd_error").alias("usd_error"),
    ]
    if not local:
        aggs.append(F.sum("walltime_min").alias("walltime_min"))
    return calls.groupBy(run).agg(*aggs)
