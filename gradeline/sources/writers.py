"""Sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from gradeline.functions.text import one_line
from gradeline.operators.batch import keep_every
from gradeline.operators.sampling import first_wins
from gradeline.session import delete, pin


def sample_tag(seed: int, num: int | None = None) -> str:
    """Name of a sample: n1000_seed7, or full_seed7."""
    return f"full_seed{seed}" if num is None else f"n{num}_seed{seed}"


def _ordered(df: DataFrame) -> DataFrame:
    """Rows in index order over the files. Derive costly columns after this: its sampling reads
    ``df`` once more."""
    return df.repartitionByRange("idx").sortWithinPartitions("idx")


def write_views(
    out_dir: str, tag: str, questions: DataFrame, gold: DataFrame, offsets: DataFrame | None = None
) -> dict[str, str]:
    """Write the aligned views as JSON lines in index order, ``idx`` included; returns their paths."""
    named = {"questions": questions, "gt": gold}
    if offsets is not None:
        named["offsets"] = offsets.select("idx", "line", "offset")
    paths = {}
    for name, view in named.items():
        paths[name] = f"{out_dir}/{tag}_{name}"
        _ordered(view).write.json(paths[name])
    return paths


def read_view(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_full(df: DataFrame, path: str, fmt: str = "json", order_by: Sequence[str | Column] = ()) -> None:
    """The canonical table, over the files in the given order if there is one; JSON leaves NULL fields out."""
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    rows.write.format(fmt).save(path)


def write_counted(
    df: DataFrame,
    path: str,
    counts: Mapping[str, Column] | None = None,
    hidden: Sequence[str] = (),
    expected: int | None = None,
    fmt: str = "parquet",
) -> dict:
    """Write ``df`` and return ``n_rows`` and ``counts`` (name -> aggregate), which the write itself took.

    Nothing is read again to count it. Rows are counted in the tasks that write them, where a task
    run twice counts once. ``hidden`` columns serve the counts only and are not written. If it is
    not ``expected`` rows, the files are deleted again and an error raised.
    """
    seen = Observation()
    measured = [F.count("*").alias("n_rows"), *[c.alias(name) for name, c in (counts or {}).items()]]
    df.observe(seen, *measured).drop(*hidden).write.format(fmt).save(path)
    found = seen.get
    if expected is not None and found["n_rows"] != expected:
        delete(df.sparkSession, path)
        raise ValueError(f"expected {expected:,} rows, found {found['n_rows']:,}")
    return found


def write_first_wins(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], path: str, expected: int | None = None, fmt: str = "parquet"
) -> dict[str, int]:
    """Write the first row of every key; returns n_read, n_kept and n_dropped, all taken by that write."""
    kept = first_wins(df, keys, order_by, copies="_copies")
    n_read = {"n_read": F.coalesce(F.sum("_copies"), F.lit(0))}
    found = write_counted(kept, path, n_read, hidden=["_copies"], expected=expected, fmt=fmt)
    return {"n_read": found["n_read"], "n_kept": found["n_rows"], "n_dropped": found["n_read"] - found["n_rows"]}


def write_fallback_labels(labels: DataFrame, path: str) -> None:
    labels.write.parquet(path)


def write_predictions(records: DataFrame, out_path: str, raw_path: str, raw_every: int = 1) -> None:
    """One line per prediction in index order, and every k-th raw record as JSON.

    The records are written once first, so a model among their columns answers each prompt once.
    """
    records = pin(records, "records")
    write_prediction_lines(records, out_path)
    write_raw_records(keep_every(records, raw_every), raw_path)


def write_prediction_lines(preds: DataFrame, path: str) -> None:
    """One line per prediction in index order."""
    _ordered(preds.select("idx", "pred")).select(one_line(F.col("pred")).alias("value")).write.text(path)


def write_raw_records(records: DataFrame, path: str) -> None:
    """The raw columns of the records as JSON lines in index order."""
    raw = [c for c in ("idx", "request", "cost", "walltime_min", "response") if c in records.columns]
    _ordered(records.select(*raw)).write.json(path)


def write_batch_requests(requests: DataFrame, path: str) -> None:
    """One {custom_id, body} per line."""
    keyed = F.struct(F.col("idx").cast("string").alias("custom_id"), "body")
    _ordered(requests.select("idx", "body")).select(F.to_json(keyed).alias("value")).write.text(path)


def write_document(one_row: DataFrame, path: str) -> None:
    """A metrics, summary or selection document: the only row as JSON."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value")).write.text(path)


def write_training_sets(rows: DataFrame, path: str, keep: Sequence[str] | None = None) -> None:
    """Training and held-out rows below part=train and part=eval."""
    columns = rows if keep is None else rows.select(*keep, "part")
    columns.write.partitionBy("part").json(path)
