"""Raw files to a canonical table to aligned views of a seeded sample."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeline.operators.checks import expect_at_least
from gradeline.operators.sampling import first_wins, lift_single_attribute, seeded_order, views
from gradeline.operators.shaping import join_metadata, shape_detection, shape_relevance
from gradeline.schemas import DETECTION_GOLD, EXTRACTION_FULL
from gradeline.session import pin
from gradeline.sources.readers import (
    line_offsets, read_parts, read_quoted_csv, read_raw_lines, read_shards, split_starts, with_line_numbers,
)
from gradeline.sources.writers import read_view, sample_tag, write_views


# Rows of the three published workloads, for ``expect_rows``.
WORKLOAD_ROWS = {"extraction": 4_767_579, "relevance": 2_621_288, "detection": 5_615_820}


def build_relevance(spark: SparkSession, shards: str) -> DataFrame:
    """Canonical relevance rows: the first of every example id in shard order."""
    shaped = shape_relevance(read_shards(spark, shards))
    return first_wins(shaped, ["example_id"], ["file_path", "row_index"]).drop("file_path", "row_index")


def build_detection(spark: SparkSession, csv: str) -> DataFrame:
    return shape_detection(read_quoted_csv(spark, csv, [*DETECTION_GOLD, "generation"]))


def build_extraction(spark: SparkSession, parts: Sequence[str], schema: str = EXTRACTION_FULL) -> DataFrame:
    return read_parts(spark, parts, schema)


def build_from_metadata(labels: DataFrame, metadata: DataFrame, key: str, paragraphs: Sequence[str]) -> DataFrame:
    return join_metadata(labels, metadata, key, paragraphs)


def read_full(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A canonical JSON-lines table with each row's ``line``."""
    return _parsed(with_line_numbers(read_raw_lines(spark, path)), schema)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select("line", F.from_json("value", schema).alias("row")).select("line", "row.*")


def sample_full(
    spark: SparkSession,
    full_path: str,
    schema: str,
    out_dir: str,
    question_fields: Sequence[str],
    seed: int | None = None,
    num: int | None = None,
    single_attribute: bool = False,
    key: str = "line",
) -> dict[str, str]:
    """Shuffle the canonical table by seed, keep ``num`` rows (all if None), write the three views.

    The shuffle goes by ``key``. Name the record's own unique id: the sample is then the same however
    the table was cut into files. By line number it is the same for the same order of lines only.

    The sample is written once; the views are read off it. Without a seed the clock gives one, and
    the returned paths name it. Asking for more rows than there are is an error.
    """
    seed = int(time.time()) if seed is None else seed
    lines = read_raw_lines(spark, full_path)
    starts = split_starts(lines)  # of both the line numbers and the offsets
    sample = seeded_order(_parsed(with_line_numbers(lines, starts), schema), key, seed, num)
    if single_attribute:
        sample = lift_single_attribute(sample)
    sample = pin(sample, "sample")
    if num is not None:
        expect_at_least(sample, num)
    offsets = sample.select("idx", "line").join(line_offsets(lines, starts), "line")
    shown = [f for f in question_fields if f in sample.columns]
    gold = [c for c in sample.columns if c not in (*shown, "idx", "line")]
    questions, gold_view = views(sample, shown, gold)
    return write_views(out_dir, sample_tag(seed, num), questions, gold_view, offsets)


def load_sample(
    spark: SparkSession, out_dir: str, tag: str, question_schema: str, gold_schema: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Question view, and gold view unless the read is to be free of labels. Schemas without idx."""
    questions = read_view(spark, f"{out_dir}/{tag}_questions", f"idx BIGINT, {question_schema}")
    if gold_schema is None:
        return questions, None
    return questions, read_view(spark, f"{out_dir}/{tag}_gt", f"idx BIGINT, {gold_schema}")
