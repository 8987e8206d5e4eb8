"""The corpus pipeline: language, boilerplate lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns
is written as Parquet and read again as the docs of the next. All stages but the last return the
columns of their docs. Every stage takes NULLs in any column, empty, repeated and very long texts,
and an empty table; columns of other names go through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeline.llm import language, lines, packing, pii, simhash
from gradeline.llm.queries import LANGUAGE_SAMPLE, LEAST_SITES, PII_SAMPLE
from gradeline.session import pin

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language is not found: without a letter, or between two languages.

    The classifiers learn from the labelled rows of the same docs; a missing label drops nothing. If
    no row is labelled there is nothing to judge by, and only texts without a letter go.
    """
    model = language.learn(docs, "text", "lang", LANGUAGE_SAMPLE)
    return language.recognised(docs, "text", model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that many sites share; every row stays."""
    return lines.remove_boilerplate(docs, "text", "source", LEAST_SITES, counted="n_chars")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, with the smallest doc_id, of each group of near duplicates by SimHash."""
    return simhash.keep_one(docs, "text", "doc_id", shingle=4, distance=4)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; every row stays."""
    return pii.mask(docs, "text", pii.learn(docs, "text", PII_SAMPLE), counted="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of 2048 ids: a row per piece of a document."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("personal_data", personal_stage),
    ("packing", packing_stage),
]

#: The classifiers and the retrieval have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
