"""Raw rows to canonical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.schemas import DETECTION_GOLD

# Columns of the relevance task.
RELEVANCE_IDS = ("example_id", "query_id", "product_id")
RELEVANCE_PRODUCT = (
    "product_title", "product_brand", "product_color", "product_description", "product_bullet_point",
)


def shape_relevance(raw: DataFrame) -> DataFrame:
    """Ids as strings, renamed label and locale. NULL product fields vanish when written as JSON."""
    return raw.select(
        *[F.col(c).cast("string").alias(c) for c in RELEVANCE_IDS],
        "query",
        *RELEVANCE_PRODUCT,
        F.col("esci_label").alias("label"),
        F.col("product_locale").alias("locale"),
        F.col("large_version").cast("int").alias("large_version"),
        "split",
        *[c for c in ("file_path", "row_index") if c in raw.columns],
    )


def shape_detection(raw: DataFrame) -> DataFrame:
    """The generation as ``text`` plus the gold fields."""
    return raw.select(F.col("generation").alias("text"), *DETECTION_GOLD)


def machine_tally(detection: DataFrame) -> DataFrame:
    """Documents, human and machine."""
    human = F.col("model") == "human"
    return detection.agg(
        F.count("*").alias("n_rows"), F.count_if(human).alias("n_human"), F.count_if(~human).alias("n_machine")
    )


def join_metadata(
    labels: DataFrame, metadata: DataFrame, key: str, paragraphs: Sequence[str]
) -> DataFrame:
    """Product labels with their product's text columns as an array of paragraphs, empty ones left out."""

    def paragraph(name: str) -> Column:
        return F.when(
            F.coalesce(F.col(name), F.lit("")) != "", F.struct(F.col(name).alias("text"), F.lit(name).alias("source"))
        )

    listed = F.array_compact(F.array(*[paragraph(p) for p in paragraphs]))
    texts = metadata.select(key, *[c for c in metadata.columns if c != key])
    return labels.join(texts, key).withColumn("paragraphs", listed).drop(*paragraphs)


def union_parts(*parts: DataFrame) -> DataFrame:
    """Ordered concatenation: ``part_no`` and the row's own order key give the file order."""
    merged = None
    for number, part in enumerate(parts):
        numbered = part.withColumn("part_no", F.lit(number))
        merged = numbered if merged is None else merged.unionByName(numbered)
    return merged
