"""Spend of runs while their call log grows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeline import schemas
from gradeline.functions.usage import with_usage
from gradeline.operators.cost import MTOK, mtok_cost
from gradeline.operators.ledger import first_exhausted, running_ledger
from gradeline.session import pin, scratch_scope
from gradeline.streaming.keyed import KeyedTable
from gradeline.streaming.sinks import each_batch

ORDER = ("time", "seq")


def read_call_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The append-only call log as a stream."""
    reader = spark.readStream.schema(schemas.CALL_HISTORY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def metered(calls: DataFrame) -> DataFrame:
    """Every logged call with its usage and cost; calls that failed or cannot be read cost NULL."""
    used = with_usage(calls, "response")
    billed = F.when(F.col("status_code") == 200, mtok_cost(F.col("usage")))
    return used.withColumn("mtok", billed)


def spend_totals(calls: DataFrame) -> DataFrame:
    """Running totals per run as a streaming aggregate; costs combine before the shuffle."""
    return metered(calls).groupBy("run").agg(
        F.count("mtok").alias("n_billed"),
        F.count("*").alias("n_calls"),
        F.coalesce(F.sum("mtok"), F.lit(0)).cast(MTOK).alias("spent_mtok"),
    )


class LedgerStream:
    """Balances per call, kept below ``root``: ledger/ and exhausted/ by batch number, and state/.

    A batch is one distributed prefix sum that starts from the balances of the runs it touches, so a
    run that dominates a batch is still split over tasks, and only touched balances are written.
    Writing a batch again gives the same files. Calls count in order of arrival; inside a batch by
    time and sequence number.
    """

    def __init__(self, root: str, budget: float | str | Decimal):
        self.root, self.budget = root, budget
        self.state = KeyedTable(f"{root}/state", ["run"])

    def _path(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}/batch={number}"

    def handle(self, batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            self._write(batch, number)

    def _write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # written once, so that the bodies are not parsed again to see which runs are touched
        calls = pin(metered(batch).select("run", *ORDER, "status_code", "usage_reason", "mtok"), "calls")
        opening = self.state.before(spark, number)
        if opening is not None:
            touched = calls.select(F.col("run").alias("touched")).distinct()
            opening = opening.join(touched, F.col("run").eqNullSafe(F.col("touched")), "left_semi")
        ledger = running_ledger(calls, self.budget, ORDER, opening=opening)
        ledger.write.mode("overwrite").parquet(self._path("ledger", number))
        written = spark.read.parquet(self._path("ledger", number))
        first_exhausted(written, self.budget).write.mode("overwrite").parquet(self._path("exhausted", number))
        # balances never fall, so the largest of a batch is its last
        self.state.write(written.groupBy("run").agg(F.max("spent_after").alias("opening")), number)

    def balances(self, spark: SparkSession) -> DataFrame:
        """(run, opening): the balance of every run after the last batch."""
        return self.state.current(spark)

    def run(self, calls: DataFrame) -> None:
        """Process what has arrived since the last run and stop."""
        each_batch(calls, self.handle, f"{self.root}/checkpoint")

    def ledger(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/ledger").drop("batch")

    def exhausted(self, spark: SparkSession) -> DataFrame:
        """One row per run that has used up its budget: the call that did it."""
        return spark.read.parquet(f"{self.root}/exhausted").drop("batch")
