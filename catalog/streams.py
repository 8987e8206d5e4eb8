"""Streaming queries: the test tables as append-only logs, read as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import accounting, audits, inputs, scores
from catalog.base import derive, table
from gradeline.session import fresh_path
from gradeline.streaming.ledger import LedgerStream, metered, read_call_log, spend_totals
from gradeline.streaming.requests import read_request_log, request_totals
from gradeline.streaming.sinks import append_output, read_totals, write_totals

_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6"


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, inputs.CALLS).select(
        F.expr(_SECONDS).alias("time"), "run", F.col("idx").alias("seq"), "model",
        F.lit("/api/v1/chat/completions").alias("path"), F.col("status_code").cast("int").alias("status_code"),
        F.lit("{}").alias("request"), F.col("body").alias("response"),
    )


def _call_log(spark: SparkSession, sf_dir: str) -> str:
    """Events written as a call log in JSON lines."""
    path = fresh_path(spark, "calls")
    _logged(spark, sf_dir).write.json(path)
    return path


#: Times that the log of a growing stream is read.
ARRIVALS = 6


def _growing_ledger(spark: SparkSession, sf_dir: str) -> LedgerStream:
    """A ledger whose log grows in order of time, read after each arrival."""
    calls, path = _logged(spark, sf_dir), fresh_path(spark, "calls")
    stream = LedgerStream(fresh_path(spark, "ledger"), accounting.BUDGET)
    cuts = calls.approxQuantile("time", [i / ARRIVALS for i in range(1, ARRIVALS)], 0.01)
    arrival = sum((F.coalesce((F.col("time") >= cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0))
    for number in range(ARRIVALS):
        calls.where(arrival == number).write.mode("append").json(path)
        stream.run(read_call_log(spark, path))
    return stream


def _ledger_stream(spark: SparkSession, sf_dir: str) -> LedgerStream:
    stream = LedgerStream(fresh_path(spark, "ledger"), accounting.BUDGET)
    stream.run(read_call_log(spark, _call_log(spark, sf_dir)))
    return stream


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger_stream(spark, sf_dir).ledger(spark)
    return ledger.select(
        F.col("seq").alias("idx"), "run", *[accounting._num(c) for c in ("spent_before", "spent_after", "remaining")], "exhausted"
    )


def exhausted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of a log that grew over several micro-batches."""
    signals = _growing_ledger(spark, sf_dir).exhausted(spark)
    return signals.select("run", F.col("seq").alias("idx"), accounting._num("spent_after"))


def balances_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every run has spent after several micro-batches, from the balances kept for the next one."""
    balances = _growing_ledger(spark, sf_dir).balances(spark)
    return balances.select("run", accounting._num("opening").alias("spent_mtok"))


BALANCES_STREAM = f"""{accounting._CALLS_CTE}
SELECT run, {accounting._num_sql('coalesce(sum(mtok), 0)', 'spent_mtok')} FROM paid GROUP BY run"""


def spend_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_call_log(spark, _call_log(spark, sf_dir))
    root = fresh_path(spark, "spend")
    write_totals(spend_totals(calls), f"{root}/totals", f"{root}/checkpoint", ["run"])
    totals = read_totals(spark, f"{root}/totals", ["run"])
    return totals.select("run", "n_billed", "n_calls", accounting._num("spent_mtok"))


SPEND_STREAM = f"""{accounting._CALLS_CTE}
SELECT run, count(mtok) AS n_billed, count(*) AS n_calls, {accounting._num_sql('coalesce(sum(mtok), 0)', 'spent_mtok')} FROM paid GROUP BY run"""


def metered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log as a stream into a metered table, in two runs that share a checkpoint."""
    root, source = fresh_path(spark, "metered"), _call_log(spark, sf_dir)
    for _ in range(2):  # the second run finds nothing new and repeats nothing
        calls = metered(read_call_log(spark, source))
        append_output(calls.select("run", "seq", "mtok", "usage_reason"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(F.col("seq").alias("idx"), "run", accounting._num("mtok"), "usage_reason")


METERED_STREAM = f"""{accounting._CALLS_CTE}
SELECT idx, run, {accounting._num_sql('mtok')}, CASE WHEN body = '' THEN 'empty body' WHEN u IS NULL THEN 'usage missing'
  WHEN i IS NULL OR o IS NULL THEN 'usage incomplete' END AS usage_reason FROM paid"""


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request totals of a log that grew over several micro-batches, of which each wrote what it changed."""
    root, keys = fresh_path(spark, "requests"), ["status_code", "blocked_by", "loopback"]
    status = F.when(F.contains("url", F.lit("https")), 200).otherwise(301).alias("status_code")
    for number in range(ARRIVALS):
        some = table(spark, sf_dir, "pages").where(F.col("page_id") % ARRIVALS == number)
        some.select("url", status).write.mode("append").json(f"{root}/log")
        totals = request_totals(read_request_log(spark, f"{root}/log"), audits.GROUPS)
        write_totals(totals, f"{root}/totals", f"{root}/checkpoint", keys)
    return read_totals(spark, f"{root}/totals", keys)


def documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection replies as a stream of files into a prediction table, each input row once."""
    from gradeline.functions.replies import detection_score

    root = fresh_path(spark, "replies")
    derive(spark, sf_dir, inputs.DETECTION_REPLIES).write.json(f"{root}/in")
    for _ in range(2):
        replies = spark.readStream.schema("idx BIGINT, pred STRING").json(f"{root}/in")
        append_output(replies.select("idx", detection_score(F.col("pred")).alias("score")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


QUERIES = {
    "ledger_stream": (ledger_stream, accounting.RUNNING_LEDGER),
    "exhausted_stream": (exhausted_stream, accounting.FIRST_EXHAUSTED),
    "balances_stream": (balances_stream, BALANCES_STREAM),
    "spend_stream": (spend_stream, SPEND_STREAM),
    "metered_stream": (metered_stream, METERED_STREAM),
    "request_stream": (request_stream, audits.REQUEST_COUNTS),
    "documents_stream": (documents_stream, scores.DETECTION_REPLIES),
}
