"""How registered queries get at the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a portable statement over the test tables, which it names as $table."""
    names = set(re.findall(r"\$(\w+)", sql))
    text = sql.replace("{", "{{").replace("}", "}}")
    text = re.sub(r"\$(\w+)", r"{\1}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The same statement for the oracle, where the tables are views."""
    return re.sub(r"\$(\w+)", r"\1", sql)
