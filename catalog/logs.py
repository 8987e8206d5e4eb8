"""Queries over logged responses and over the files of runs that were interrupted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import derive, plain, table
from gradeline.functions.usage import COUNTERS, with_usage
from gradeline.operators.sampling import seeded_order
from gradeline.session import fresh_path, pin
from gradeline.sources import readers
from gradeline.sources.run_files import RunFiles

# ---- responses byte for byte ----------------------------------------------------------------

# Numbers, blanks and escapes that a parser would write in another way.
RESPONSES = """
SELECT event_id AS idx, concat('{"id":  "r', CAST(event_id AS STRING), '", "price": ', CAST(event_id AS STRING), '.10,   "rate": 1e-7, ',
  CASE WHEN event_type = 'view' THEN '"choices": [ ]' ELSE concat('"choices":[{"message" : {"content":"', event_type, chr(92), 'u00e9"}}]') END, '}') AS body
FROM $events"""


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records and batch results through their files: replies, and what stands for a missing one."""
    responses = derive(spark, sf_dir, RESPONSES)
    calls, batches = fresh_path(spark, "calls"), fresh_path(spark, "batches")
    number = F.col("idx").cast("string")
    responses.select(F.concat(F.lit('{"idx": '), number, F.lit(', "cost": {"mtok": 0.5}, "response": '), "body", F.lit(' , "x": 1}'))).write.text(calls)
    responses.select(
        F.concat(
            F.lit('{"id": "b", "results": [{"custom_id": "'), number, F.lit('", "response": {"status_code": 200, "body":'), "body", F.lit("}}]}")
        )
    ).write.text(batches)
    logged = readers.read_calls(spark, calls)
    returned = readers.read_batch_results(spark, batches)
    both = logged.join(returned.select("idx", F.col("raw").alias("body")), "idx")
    content = F.get(F.col("response.choices"), F.lit(0))["message"]["content"]
    return both.select("idx", F.md5("raw").alias("raw_md5"), F.md5("body").alias("body_md5"), content.alias("content"))


RAW_TEXT = f"""
SELECT idx, md5(body) AS raw_md5, md5(body) AS body_md5, CASE WHEN NOT contains(body, '[ ]') THEN event_type || chr(233) END AS content
FROM ({plain(RESPONSES)}) r JOIN events ON event_id = idx"""

# ---- usage of streams -----------------------------------------------------------------------

_GOOD = """concat('data: {"usage": {"prompt_tokens": ', CAST(event_id + 30 AS STRING), ', "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 10, "cache_write_tokens": 20}}}', chr(10))"""
_BROKEN = "concat('data: {\"choices\": [', chr(10))"
STREAMS = f"""
SELECT event_id AS idx, event_id % 7 AS form, CASE event_id % 7
  WHEN 0 THEN {_GOOD}
  WHEN 1 THEN concat({_BROKEN}, {_GOOD})
  WHEN 2 THEN concat({_GOOD}, {_BROKEN}, {_GOOD})
  WHEN 3 THEN concat({_GOOD}, {_BROKEN})
  WHEN 4 THEN concat('data: {{"usage": 5}}', chr(10), ': ping', chr(10), {_GOOD}, 'data: [DONE]', chr(10))
  WHEN 5 THEN concat('data: []', chr(10), {_GOOD})
  ELSE concat({_GOOD}, 'data: {{"usage": null}}', chr(10)) END AS body
FROM $events"""


def usage_every_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of streamed bodies with a broken chunk before, between or after good ones, or none."""
    used = with_usage(derive(spark, sf_dir, STREAMS))
    return used.select("idx", *[F.col("usage")[c].alias(c) for c in COUNTERS], "usage_reason")


USAGE_EVERY_CHUNK = """
SELECT event_id AS idx, CASE WHEN fine THEN event_id END AS input_tokens, CASE WHEN fine THEN 7::BIGINT END AS output_tokens,
  CASE WHEN fine THEN 10::BIGINT END AS cache_read_input_tokens, CASE WHEN fine THEN 20::BIGINT END AS cache_creation_input_tokens,
  CASE WHEN fine THEN NULL WHEN event_id % 7 = 6 THEN 'usage missing' ELSE 'malformed chunk' END AS usage_reason
FROM (SELECT *, event_id % 7 IN (0, 4) AS fine FROM events)"""

# ---- interrupted runs -----------------------------------------------------------------------

SEED = 11
_ORDER = f"row_number() OVER (ORDER BY md5(concat('{SEED}:', doc_id)), doc_id) - 1"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = seeded_order(table(spark, sf_dir, "documents"), "doc_id", SEED)
    cost = (F.col("n_chars") / 1000).cast("decimal(28,9)").alias("mtok")
    # a run's dataset is a stored sample: its rows are put in order once, not for every append
    return pin(sample.select("idx", F.col("text").alias("pred"), F.col("source").alias("response"), cost), "sample")


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that wrote every other row, was cut inside its second append, and was resumed.

    The rows come back once each, with the append that brought them, and as lines in index order.
    """
    records = _records(spark, sf_dir)
    run = RunFiles(spark, fresh_path(spark, "run"))
    run.append(records.where("idx % 2 = 0"))
    run.write_part(records.where("idx % 4 = 1"))  # files without a commit: the process ended here
    run.append(records)
    out, raw = fresh_path(spark, "out"), fresh_path(spark, "raw")
    run.export(out, raw, "idx BIGINT, response STRING")
    lines = readers.read_predictions(spark, out).select("idx", F.md5("pred").alias("line_md5"))
    logged = readers.read_json_lines(spark, raw, "idx BIGINT, response STRING")
    found = run.numbered().select("idx", F.md5("pred").alias("pred_md5"), F.col("number").alias("append_no"))
    return found.join(lines, "idx").join(logged, "idx")


RESUMED_RUN = f"""
SELECT idx, md5(text) AS pred_md5, CAST(idx % 2 AS INTEGER) AS append_no, source AS response,
  md5(CASE WHEN contains(text, chr(10)) THEN to_json(text)::VARCHAR ELSE text END) AS line_md5
FROM (SELECT {_ORDER} AS idx, text, source FROM documents)"""


def resumed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and spend of runs: cut inside a write, whole, with raw records missing, of another dataset."""
    records = _records(spark, sf_dir)
    states = None
    for name, dataset, every in (
        ("cut", records, 1), ("whole", records, 1), ("thin raw", records, 1), ("other", records.where("idx % 3 > 0"), 1),
    ):
        run = RunFiles(spark, fresh_path(spark, "run"))
        run.append(records.where("idx % 2 = 0"), raw_every=4 if name == "thin raw" else 1)
        if name == "cut":
            run.write_part(run.pending(records))
        elif name == "whole":
            run.append(records)
        spent = F.lit(run.spent()).cast("double").alias("spent")
        state = run.state(dataset, every).select(F.lit(name).alias("run"), "*", F.round(spent, 6).alias("spent"))
        states = state if states is None else states.unionByName(state)
    return states


RESUMED_STATES = f"""
WITH r AS (SELECT {_ORDER} AS idx, n_chars / 1000::DOUBLE AS mtok FROM documents),
c AS (
  SELECT count(*) AS n, count(*) FILTER (idx % 2 = 0) AS even, count(*) FILTER (idx % 4 = 0) AS fourth, count(*) FILTER (idx % 3 > 0) AS other,
    count(*) FILTER (idx % 3 > 0 AND idx % 2 = 1) AS other_left, round(sum(mtok), 6) AS paid, round(sum(mtok) FILTER (idx % 2 = 0), 6) AS half
  FROM r
)
SELECT 'cut' AS run, n AS n_dataset, even AS n_out, even AS n_raw, n - even AS n_pending, NULL::VARCHAR AS problem, half AS spent FROM c
UNION ALL SELECT 'whole', n, n, n, 0, NULL, paid FROM c
UNION ALL SELECT 'thin raw', n, even, fourth, n - even, 'out and raw differ', half FROM c
UNION ALL SELECT 'other', other, even, even, other_left, 'a prediction has no row in the dataset', half FROM c"""

QUERIES = {
    "raw_text": (raw_text, RAW_TEXT),
    "usage_every_chunk": (usage_every_chunk, USAGE_EVERY_CHUNK),
    "resumed_run": (resumed_run, RESUMED_RUN),
    "resumed_states": (resumed_states, RESUMED_STATES),
}
