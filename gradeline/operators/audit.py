"""Request logs: verdicts, blocked URLs, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.urls import blocked_group, is_chat_call, is_loopback, url_host
from gradeline.session import pin

#: Characters of the substrings that a long blocklist is looked up by.
GRAM = 5


def with_url_flags(requests: DataFrame, groups: Sequence[Sequence[str]], url: str = "url") -> DataFrame:
    """Add ``host``, ``blocked_by`` (position of the first matching group) and ``loopback``."""
    host = url_host(F.col(url))
    return requests.withColumn("host", host).withColumns(
        {"blocked_by": blocked_group(F.col(url), groups), "loopback": is_loopback(F.col("host"))}
    )


def _grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters; of size 0 the empty one."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))), F.array().cast("array<string>"))


def group_index(groups: DataFrame) -> DataFrame:
    """(gram, position, parts): each group of (position, parts) under one gram its URLs must hold.

    A gram is ``GRAM`` characters of a part, or all of a shorter one. Of a group's grams the one that
    the fewest groups hold stands for it, so what most hosts share ("http", ".com") leads to no group
    that has something rarer. A group without parts is under the empty gram, which all URLs hold.
    """
    parts = F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda p: F.lower(p))
    lowered = groups.select("position", F.filter(parts, lambda p: p != "").alias("parts"))
    held = F.flatten(F.transform("parts", lambda p: F.when(F.length(p) < GRAM, F.array(p)).otherwise(_grams(p, GRAM))))
    keyed = lowered.select("position", "parts", F.explode_outer(F.array_distinct(held)).alias("gram"))
    keyed = keyed.withColumn("gram", F.coalesce("gram", F.lit("")))
    shared = keyed.groupBy("gram").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("gram") == "", -F.length("gram"), "n", "gram")).alias("best")
    return keyed.join(shared, "gram").groupBy("position", "parts").agg(best).select("best.gram", "position", "parts")


def blocked_by_list(requests: DataFrame, groups: DataFrame, url: str = "url") -> DataFrame:
    """Add ``blocked_by``, the smallest position of a group all of whose parts occur in the URL, or NULL.

    ``groups`` (position int, parts array) is a table, of any length: ``blocked_group`` has a branch
    per group, this finds the groups of a URL by their grams and compares only those. Case does not
    matter; a NULL URL is in no group; empty parts are in every URL. Each distinct URL is looked at
    once, and of its grams only those that stand for a group go on.
    """
    index = pin(group_index(groups), "group_index")
    sizes = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())  # 0 to GRAM
    lowered = F.lower(F.col(url))
    urls = requests.select(lowered.alias("_url")).where("_url IS NOT NULL").distinct()
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_url"), n) for n in sizes or [0]])))
    found = urls.select("_url", F.explode(grams).alias("gram")).join(index, "gram")
    found = found.where(F.forall("parts", lambda p: F.contains("_url", p)))
    first = found.groupBy("_url").agg(F.min("position").alias("blocked_by"))
    return requests.join(first, lowered == F.col("_url"), "left").drop("_url")


def verdict(
    key_ok: Column, budget_spent: Column, model_allowed: Column, enforce_budgets: bool = True
) -> tuple[Column, Column]:
    """(verdict, status) of a request with url flags, host, method and path; the order decides.

    Status is NULL where the request is forwarded.
    """
    chat = is_chat_call(F.col("host"), F.col("method"), F.col("path"))
    spent = budget_spent if enforce_budgets else F.lit(False)
    steps = [
        (F.col("blocked_by").isNotNull(), "blocked", 403),
        (F.col("loopback"), "loopback", 403),
        (chat & ~F.coalesce(key_ok, F.lit(False)), "bad key", 403),
        (chat & F.coalesce(spent, F.lit(False)), "budget spent", 402),
        (chat & ~F.coalesce(model_allowed, F.lit(False)), "model not allowed", 403),
    ]
    name, status = F.lit("forward"), F.lit(None).cast("int")
    for condition, text, code in reversed(steps):
        name = F.when(condition, F.lit(text)).otherwise(name)
        status = F.when(condition, F.lit(code)).otherwise(status)
    return name, status


def mark_allowed(requests: DataFrame, usable: DataFrame, model: str = "model") -> DataFrame:
    """Add ``model_allowed``: whether the model is in the (distinct) table of usable models."""
    known = usable.select(F.col("model").alias("_known"))
    return (
        requests.join(known, F.col(model) == F.col("_known"), "left")
        .withColumn("model_allowed", F.col("_known").isNotNull())
        .drop("_known")
    )


def request_counts(flagged: DataFrame) -> DataFrame:
    """Requests per status, blocklist group and loopback flag."""
    return flagged.groupBy("status_code", "blocked_by", "loopback").agg(F.count("*").alias("n"))


def latest_session(events: DataFrame, run: str = "run", seq: str = "seq") -> DataFrame:
    """The session id last mentioned in each run's log."""
    return (
        events.where(F.col("session_id").isNotNull())
        .groupBy(run)
        .agg(F.max_by("session_id", seq).alias("session_id"))
    )
