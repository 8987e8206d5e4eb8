"""Token usage inside logged response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline import schemas
from gradeline.functions.text import LINE_BREAK, WHITESPACE, strip

# The four counters, and the price column that applies to each.
COUNTER_RATES = {
    "input_tokens": "base_input_per_mtok",
    "output_tokens": "output_per_mtok",
    "cache_read_input_tokens": "cache_hit_refresh_per_mtok",
    "cache_creation_input_tokens": "5m_cache_write_per_mtok",
}
COUNTERS = tuple(COUNTER_RATES)
BILLED_KEY = "harness_billed_usage"

_DATA = "data: "


def is_json_body(body: Column) -> Column:
    """Whether a body is one JSON object rather than a stream of chunks."""
    return F.startswith(F.ltrim(body, F.lit(WHITESPACE)), F.lit("{"))


def _carries_data(line: Column) -> Column:
    payload = strip(F.substring(line, len(_DATA) + 1, 1 << 30))
    return F.startswith(line, F.lit(_DATA)) & ~payload.isin("", "[DONE]")


def usage_documents(body: Column) -> Column:
    """The JSON texts of a body in order: the body itself, or the payload of every chunk."""
    chunks = F.filter(F.split(body, LINE_BREAK), _carries_data)
    payloads = F.transform(chunks, lambda line: F.substring(line, len(_DATA) + 1, 1 << 30))
    return F.when(is_json_body(body), F.array(body)).otherwise(payloads)


def usage_document(body: Column) -> Column:
    """The JSON text that should carry the usage: the body itself, or its last chunk."""
    return F.try_element_at(usage_documents(body), F.lit(-1))


# Usage as text, so that only broken JSON is malformed, whatever the fields hold.
_CHUNK = "usage STRING, _malformed STRING"
_STRICT = {"columnNameOfCorruptRecord": "_malformed", "allowSingleQuotes": "false"}


def with_usage(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``usage`` (struct of four counters, NULL if unusable) and ``usage_reason`` (NULL if fine).

    Usage is that of the last chunk, but every chunk of a stream has to be a JSON object: a malformed
    one anywhere leaves the call without usage. Prompt tokens include cache reads and writes, so both
    are taken out of the input counter.
    """
    chunks = F.transform("_documents", lambda d: F.from_json(d, _CHUNK, _STRICT))
    broken = F.exists("_documents", lambda d: ~is_json_body(d)) | F.exists("_chunks", lambda c: c["_malformed"].isNotNull())
    # a column of its own: a body is cut into documents once, whatever looks at them
    parsed = df.withColumn("_documents", usage_documents(F.col(body))).withColumn("_chunks", chunks)
    parsed = parsed.withColumn("_broken", ~is_json_body(F.col(body)) & broken)
    last = F.try_element_at("_chunks", F.lit(-1))["usage"]
    parsed = parsed.withColumn("_raw", F.when(~F.coalesce("_broken", F.lit(False)), F.from_json(last, schemas.USAGE)))
    cached = F.col("_raw.prompt_tokens_details.cached_tokens")
    written = F.col("_raw.prompt_tokens_details.cache_write_tokens")
    values = (
        F.col("_raw.prompt_tokens") - cached - written,
        F.col("_raw.completion_tokens"),
        cached,
        written,
    )
    complete = values[0].isNotNull() & values[1].isNotNull()
    reason = (
        F.when(F.coalesce(F.col(body), F.lit("")) == "", "empty body")
        .when(F.col("_broken"), "malformed chunk")
        .when(F.col("_raw").isNull(), "usage missing")
        .when(~complete, "usage incomplete")
    )
    usage = F.when(complete, F.struct(*[v.alias(n) for v, n in zip(values, COUNTERS)]))
    return parsed.withColumn("usage_reason", reason).withColumn("usage", usage).drop("_raw", "_documents", "_chunks", "_broken")


def billed_usage(usage: Column, mtok: Column) -> Column:
    """What a call was billed, as JSON text: each counter in millions, then the weighted total."""
    parts = [
        (usage[c].cast("double") / F.lit(1e6)).alias(c.removesuffix("_tokens") + "_mtok")
        for c in COUNTERS
    ]
    return F.to_json(F.struct(*parts, mtok.cast("double").alias("total_cost_mtok")))


def _splice(document: Column, billed: Column) -> Column:
    bare = strip(document)
    open_end = F.substring(bare, F.lit(1), F.length(bare) - 1)
    return F.concat(open_end, F.lit(f', "{BILLED_KEY}": '), billed, F.lit("}"))


def annotate_body(body: Column, billed: Column) -> Column:
    """The body with the billed usage added to its object, or to its last data chunk."""
    lines = F.split(body, "\n")
    marks = F.transform(lines, lambda line, i: F.when(_carries_data(line), i))
    last = F.array_max(marks)
    chunked = F.transform(
        lines,
        lambda line, i: F.when(
            i == last,
            F.concat(F.lit(_DATA), _splice(F.substring(line, len(_DATA) + 1, 1 << 30), billed)),
        ).otherwise(line),
    )
    return (
        F.when(billed.isNull(), body)
        .when(is_json_body(body), _splice(body, billed))
        .otherwise(F.array_join(chunked, "\n"))
    )
