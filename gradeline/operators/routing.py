"""Model routes: which slug and provider a call goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.functions.requests import apply_reasoning


def resolve_routes(calls: DataFrame, routes: DataFrame, model: str = "model") -> DataFrame:
    """Add slug and provider of each call's model; a model without a route is an error."""
    known = routes.select(F.col("model").alias("_model"), "slug", "provider")
    joined = calls.join(known, F.col(model) == F.col("_model"), "left")
    unknown = F.raise_error(F.concat(F.lit("no route for model "), F.coalesce(F.col(model), F.lit("NULL"))))
    return joined.withColumn("slug", F.when(F.col("_model").isNull(), unknown).otherwise(F.col("slug"))).drop("_model")


def rewrite_requests(calls: DataFrame, routes: DataFrame, request: str = "request") -> DataFrame:
    """Make requests ready to forward: slug for model, pinned provider, reasoning in one place."""
    routed = resolve_routes(calls.withColumn("_asked", F.col(request)["model"]), routes, "_asked")
    provider = F.struct(F.array("provider").alias("only"), F.lit(False).alias("allow_fallbacks"))
    ready = apply_reasoning(F.col(request).withField("model", F.col("slug")).withField("provider", provider))
    return routed.withColumn(request, ready).drop("_asked", "slug", "provider")


def usable_models(allowed: DataFrame, routes: DataFrame) -> DataFrame:
    """Models both allowed and routable."""
    return allowed.select("model").intersect(routes.select("model"))
