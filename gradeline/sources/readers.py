"""Scans of the input files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from gradeline import schemas
from gradeline.operators.shaping import union_parts
from gradeline.session import fix_splits, pin
from gradeline.sources.quoted import csv_records, parse_records


def read_shards(spark: SparkSession, path: str, schema: str = schemas.RELEVANCE_RAW) -> DataFrame:
    """Parquet shards with only the schema's columns; ``split`` is the file name up to the first '-'.

    ``file_path`` and ``row_index`` give the shard order that duplicate removal needs; in two folders
    file names may be equal.
    """
    wanted = [f.name for f in StructType.fromDDL(schema)]
    meta = F.col("_metadata")
    return spark.read.schema(schema).parquet(path).select(
        *wanted,
        F.split_part(meta["file_name"], F.lit("-"), F.lit(1)).alias("split"),
        meta["file_path"].alias("file_path"),
        meta["row_index"].alias("row_index"),
    )


def read_quoted_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with header, quoted line breaks, doubled quotes and fields of any length; all strings.

    ``columns`` are found by their names in each file's header; others are not kept. Empty fields stay
    empty strings. Files are cut like any text, also inside quoted fields, so one large file is read
    by many tasks; the records found are written once. Quote marks inside unquoted fields are not CSV.
    """
    return parse_records(csv_records(read_raw_lines(spark, path)), columns)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, cut at '\\n' only."""
    return spark.read.option("lineSep", "\n").schema(schema).json(path)


def read_parts(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Several JSON-lines files as one table: (part_no, line) is the order of the files as given."""

    def one(path: str) -> DataFrame:
        lines = with_line_numbers(read_raw_lines(spark, path))
        return lines.select(F.from_json("value", schema).alias("row"), "line").select("row.*", "line")

    return union_parts(*[one(p) for p in paths])


def read_raw_lines(spark: SparkSession, path: str, line_sep: str | None = "\n") -> DataFrame:
    """Text lines with the position of their split and their order inside it.

    The order is fixed at the scan, before any shuffle.
    """
    fix_splits(spark)
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    meta = F.col("_metadata")
    return reader.text(path).select(
        "value",
        meta["file_path"].alias("file_path"),
        meta["file_block_start"].alias("block_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _file_order(path: str) -> list[Column]:
    """Folder, part number, name: as text, part 100000 would come before part 99999."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    number = F.regexp_extract(name, r"^part-([0-9]+)", 1).try_cast("bigint")
    return [F.regexp_replace(path, "[^/]*$", ""), number, F.col(path)]


def split_starts(lines: DataFrame) -> DataFrame:
    """Per split of the scan: rows and bytes before it, and its first sequence number.

    One row per split, written: joins then know its size and need not move the lines to meet it. The
    same table serves every scan of the files that cuts them alike. Sums go up by level, splits in
    their file, files in their folder, then folders, so no task sees the splits of all files.
    """
    size = F.octet_length("value").cast("bigint") + 1
    splits = lines.groupBy("file_path", "block_start").agg(
        F.count("*").alias("_n"), F.sum(size).alias("_bytes"), F.min("_seq").alias("_first")
    )
    def before(amount: str, *within: str, order: list) -> Column:
        earlier = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(amount).over(earlier), F.lit(0))

    folder, number, name = _file_order("file_path")
    splits = splits.withColumns(
        {
            "_in_file": before("_n", "file_path", order=["block_start"]),
            "_bytes_before": before("_bytes", "file_path", order=["block_start"]),
        }
    )
    files = splits.groupBy("file_path").agg(F.sum("_n").alias("_file_n")).withColumn("_folder", folder)
    files = files.withColumn("_in_folder", before("_file_n", "_folder", order=[number, name]))
    folders = files.groupBy("_folder").agg(F.sum("_file_n").alias("_folder_n"))
    folders = folders.withColumn("_before_folder", before("_folder_n", order=["_folder"])).drop("_folder_n")
    starts = splits.join(files.join(folders, "_folder"), "file_path")
    rows_before = F.col("_before_folder") + F.col("_in_folder") + F.col("_in_file")
    kept = ["file_path", "block_start", "_n", "_first", rows_before.alias("_rows_before"), "_bytes_before"]
    return pin(starts.select(*kept), "splits")


def _numbered(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with their number; raises should this scan have cut the files in another way."""
    placed = lines.join(starts, ["file_path", "block_start"], "left").withColumn(
        "_place", F.col("_seq") - F.col("_first")
    )
    fits = (F.col("_place") >= 0) & (F.col("_place") < F.col("_n"))
    moved = F.raise_error(F.lit("the input was cut differently in two scans of it"))
    line = F.when(F.coalesce(fits, F.lit(False)), F.col("_rows_before") + F.col("_place")).otherwise(moved)
    return placed.withColumn("line", line).drop("_place")


def with_line_numbers(lines: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Add ``line``: the row's 0-based position over all files by folder, part number and name.

    Splits are counted, the counts accumulated, and added to the position inside the split; the
    lines themselves are neither sorted nor shuffled. ``starts`` are their ``split_starts``, if known.
    """
    starts = split_starts(lines) if starts is None else starts
    return _numbered(lines, starts).drop(
        "_n", "_rows_before", "_bytes_before", "_first"
    )


def line_offsets(lines: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(line, offset): the byte at which each line starts in its file ('\\n'-separated files).

    Only lengths are shuffled, and the window runs inside one split at a time. ``starts`` are the
    lines' ``split_starts``, if known.
    """
    size = F.octet_length("value").cast("bigint") + 1
    starts = split_starts(lines) if starts is None else starts
    narrow = _numbered(lines, starts).select(
        "file_path", "block_start", "line", "_bytes_before", size.alias("_size")
    )
    inside = Window.partitionBy("file_path", "block_start").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("_bytes_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return narrow.select("line", offset.alias("offset"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pred) of a prediction file: one line per row, any of the three line ends."""
    lines = with_line_numbers(read_raw_lines(spark, path, line_sep=None))
    return lines.select(F.col("line").alias("idx"), F.col("value").alias("pred"))


def parse_calls(lines: DataFrame, text: str = "value") -> DataFrame:
    """Raw call records from their JSON text; ``raw`` is the response as compact JSON of equal values.

    ``read_calls`` has it byte for byte.
    """
    return lines.select(
        F.from_json(F.col(text), schemas.RAW_CALL).alias("r"),
        F.get_json_object(F.col(text), "$.response").alias("raw"),
    ).select("r.*", "raw")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Raw call records; ``raw`` keeps the response exactly as logged, which the file reader cuts out."""
    calls = read_json_lines(spark, path, schemas.RAW_CALL_FILE).withColumnRenamed("response", "raw")
    parsed = F.from_json("raw", schemas.RESPONSE).alias("response")
    return calls.select("idx", "request", "cost", "walltime_min", parsed, "raw")


def parse_batch_requests(requests: DataFrame) -> DataFrame:
    """(idx, body) of batch requests."""
    return requests.select(F.col("custom_id").cast("bigint").alias("idx"), "body")


def parse_batch_results(batches: DataFrame) -> DataFrame:
    """(idx, response, raw) of finished batches, a row per result: the parsed fields, and the whole body.

    ``raw`` is compact JSON of equal values; ``read_batch_results`` has the body byte for byte.
    """
    return batches.select(F.explode("results").alias("r")).select(
        F.col("r.custom_id").cast("bigint").alias("idx"),
        F.from_json("r.response", schemas.BATCH_RESULT).alias("response"),
        F.get_json_object("r.response", "$.body").alias("raw"),
    )


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_batch_requests(read_json_lines(spark, path, schemas.BATCH_REQUEST))


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(idx, response, raw) of finished batches, a row per result; ``raw`` is the body exactly as logged."""
    batches = read_json_lines(spark, path, schemas.BATCH_RESULTS_FILE)
    body = F.from_json("r.response.body", schemas.RESPONSE)
    response = F.struct(F.col("r.response.status_code").alias("status_code"), body.alias("body"))
    return batches.select(F.explode("results").alias("r")).select(
        F.col("r.custom_id").cast("bigint").alias("idx"),
        F.when(F.col("r.response").isNotNull(), response).alias("response"),
        F.col("r.response.body").alias("raw"),
    )


def read_prices(spark: SparkSession, *paths: str) -> DataFrame:
    """Price tables, merged; blank cells are NULL. A model priced in two tables is an error."""
    from gradeline.operators.cost import merge_prices

    def one(path: str) -> DataFrame:
        return spark.read.option("header", True).schema(schemas.PRICES).csv(path)

    return merge_prices(*[one(p) for p in paths])


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.WEIGHTS).csv(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """(model, slug, provider); one row per model."""
    return spark.read.option("header", True).schema(schemas.ROUTES).csv(path)
