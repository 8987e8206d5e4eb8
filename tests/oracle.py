"""Run a registered query and its oracle statement and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


# DuckDB type name per Spark type name, so that a query cannot pass on equal values of other types
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(spark: SparkSession, con, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    right = _rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {f: KINDS.get(t, t) for f, t in df.dtypes}
    if any(kinds[n] != types[n] for n in names):
        return f"types {[(n, kinds[n], types[n]) for n in names if kinds[n] != types[n]]}"
    if not left:
        return "no rows"
    if left != right:
        odd = [(a, b) for a, b in zip(left, right) if a != b][:3]
        return f"{len(left)} vs {len(right)} rows; {odd}"
    return None
