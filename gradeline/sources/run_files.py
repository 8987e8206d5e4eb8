"""The files of a labelling run that may stop at any moment and go on later.

Every append writes its predictions and raw records to a folder of its own and then commits one small
manifest entry by renaming it into place. Readers go by the manifest, so what an interrupted append
has left is never seen, and a later one goes on where the last commit ended.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from gradeline.operators.batch import keep_every, pending
from gradeline.operators.cost import MTOK
from gradeline.session import pin, scratch_scope
from gradeline.sources.writers import write_prediction_lines, write_raw_records

ENTRY = f"number INT, folder STRING, n_out BIGINT, n_raw BIGINT, first_idx BIGINT, last_idx BIGINT, mtok {MTOK}"
PREDICTION = "idx BIGINT, pred STRING"


class RunFiles:
    """Predictions and raw records of one run below ``root``: manifest/, and a folder per append."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifest ----

    def _context(self):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, place, place.getFileSystem(conf), conf

    def entries(self) -> list[dict]:
        """The committed appends in order; one row an append."""
        _, place, files, _ = self._context()
        if not files.exists(place):
            return []
        # a name with a leading dot is an entry not yet committed, which Spark's readers skip
        rows = self.spark.read.schema(ENTRY).json(f"{self.root}/manifest").orderBy("number").collect()
        return [r.asDict() for r in rows]

    def _commit(self, entry: dict) -> None:
        """Put the entry in place at once; another append that took the number first is an error."""
        jvm, place, files, conf = self._context()
        files.mkdirs(place)
        path = jvm.org.apache.hadoop.fs.Path
        draft = path(place, f".{uuid.uuid4().hex}.json")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(entry, default=str).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
        context.rename(files.makeQualified(draft), files.makeQualified(path(place, f"{entry['number']:06d}.json")), none)

    # ---- writing ----

    def write_part(self, records: DataFrame, raw_every: int = 1) -> dict:
        """Write the records to a new folder; what is returned makes them part of the run once committed.

        Rows are counted and costs summed by the write itself.
        """
        folder = f"part-{uuid.uuid4().hex}"
        seen = Observation()
        spent = F.sum("mtok") if "mtok" in records.columns else F.lit(None)
        counted = records.observe(
            seen, F.count("*").alias("n_out"), F.count_if(F.col("idx") % raw_every == 0).alias("n_raw"),
            F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), spent.cast(MTOK).alias("mtok"),
        )
        with scratch_scope(self.spark):
            written = pin(counted, "records")
            written.select("idx", "pred").write.parquet(f"{self.root}/{folder}/out")
            write_raw_records(keep_every(written, raw_every), f"{self.root}/{folder}/raw")
        return {"folder": folder, **seen.get}

    def append(self, rows: DataFrame, raw_every: int = 1, label: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Add those of the rows whose idx the run does not have yet, as records (idx, pred, raw columns, mtok).

        ``label`` makes records of rows: it sees only what is left to do, so a model in it is asked
        for nothing twice. An append of no rows is committed as such. Repeated indices among the rows
        are the caller's error: see ``state``.
        """
        number, left = len(self.entries()), self.pending(rows)
        entry = {"number": number, **self.write_part(label(left) if label else left, raw_every)}
        self._commit(entry)
        return entry

    # ---- reading ----

    def _folders(self, kind: str) -> list[str]:
        return [f"{self.root}/{e['folder']}/{kind}" for e in self.entries()]

    def predictions(self) -> DataFrame:
        """(idx, pred) of all committed appends."""
        found = self._folders("out")
        if found:
            return self.spark.read.schema(PREDICTION).parquet(*found)
        # known to the planner as empty, so that rows which meet it are not moved for it
        return self.spark.range(0).select(F.col("id").alias("idx"), F.lit(None).cast("string").alias("pred")).where("false")

    def numbered(self) -> DataFrame:
        """(idx, pred, number): also the append that a prediction came with."""
        folders = {e["folder"]: e["number"] for e in self.entries()}
        if not folders:
            return self.spark.createDataFrame([], f"{PREDICTION}, number INT")
        numbers = self.spark.createDataFrame(list(folders.items()), "folder STRING, number INT")
        place = F.regexp_extract(F.col("_metadata.file_path"), r"/(part-[0-9a-f]{32})/", 1)
        return self.predictions().select("*", place.alias("folder")).join(numbers, "folder").drop("folder")

    def raw(self, schema: str) -> DataFrame:
        """The raw records of all committed appends."""
        found = self._folders("raw")
        return self.spark.read.schema(schema).json(found) if found else self.spark.createDataFrame([], schema)

    def spent(self) -> Decimal:
        """What the run has cost so far, from the manifest alone."""
        return sum((e["mtok"] or Decimal(0) for e in self.entries()), Decimal(0))

    def pending(self, dataset: DataFrame) -> DataFrame:
        """The rows of the dataset without a prediction, wherever the gaps are."""
        return pending(dataset, self.predictions())

    def state(self, dataset: DataFrame, raw_every: int = 1) -> DataFrame:
        """One row: sizes of dataset, predictions and raw records, and what is wrong (NULL if nothing).

        The predictions are counted against the dataset's indices; sizes come from the manifest.
        """
        entries = self.entries()
        n_out, n_raw = (sum(e[k] for e in entries) for k in ("n_out", "n_raw"))
        per_index = self.predictions().groupBy("idx").agg(F.count("*").alias("n"))
        met = dataset.select("idx", F.lit(1).alias("known")).join(per_index, "idx", "full")
        counts = met.agg(
            F.count("known").alias("n_dataset"), F.count_if(F.col("n") > 1).alias("twice"),
            F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("n_pending"),
            F.count_if((F.col("idx") % raw_every == 0) & F.col("n").isNotNull()).alias("raw_due"),
        )
        problem = _first(
            [
                (F.col("twice") > 0, "an index has several predictions"),
                (F.col("unknown") > 0, "a prediction has no row in the dataset"),
                (F.col("raw_due") != n_raw, "out and raw differ"),
            ]
        )
        return counts.select(
            "n_dataset", F.lit(n_out).cast("bigint").alias("n_out"), F.lit(n_raw).cast("bigint").alias("n_raw"),
            "n_pending", problem.alias("problem"),
        )

    def export(self, out_path: str, raw_path: str, raw_schema: str) -> None:
        """The run as two files in index order: one line per prediction, and the raw records."""
        write_prediction_lines(self.predictions(), out_path)
        write_raw_records(self.raw(raw_schema), raw_path)


def _first(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that holds, else NULL."""
    return F.coalesce(*[F.when(rule, message) for rule, message in rules])
