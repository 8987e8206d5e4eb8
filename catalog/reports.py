"""Guards, metric documents and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs, scores
from catalog.base import derive, plain, table
from gradeline import schemas
from gradeline.functions.usage import with_usage
from gradeline.operators import checks, cost, report, scoring
from gradeline.plans import agent_run, labelling, training
from gradeline.plans.tasks import score
from gradeline.session import fresh_path
from gradeline.sources import writers


def count_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task's count rule says to predictions that cover some, all, or more than all rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sides = (
        docs.select(F.lit("documents").alias("side")).unionAll(labels.select(F.lit("labels").alias("side")))
        .agg(F.count_if(F.col("side") == "documents").alias("n_docs"), F.count_if(F.col("side") == "labels").alias("n_labels"))
    )
    d, n = F.col("n_docs"), F.col("n_labels")
    cases = [("fewer", d, n), ("equal", d, d), ("more", n, d)]
    verdicts = F.array(
        *[
            F.struct(
                F.lit(name).alias("case"),
                checks.count_guard(gold, preds, strict=False).alias("lenient"),
                checks.count_guard(gold, preds, strict=True).alias("strict"),
            )
            for name, gold, preds in cases
        ]
    )
    return sides.select(F.explode(verdicts).alias("v")).select("v.*")


COUNT_GUARDS = """
WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM labels) AS l)
SELECT 'fewer' AS "case", NULL::VARCHAR AS lenient, l || ' predictions for ' || d || ' rows' AS strict FROM n
UNION ALL SELECT 'equal', NULL, NULL UNION ALL
SELECT 'more', d || ' predictions for ' || l || ' rows', d || ' predictions for ' || l || ' rows' FROM n"""


# Labels as rows to predict; one in seven has no prediction, and then one is given twice or belongs to no row.
_GUARD_CASES = {
    "fewer": "doc_id % 7 <> 0", "equal": "true", "twice": "true", "stray": "doc_id % 7 <> 0",
}
_GUARD_EXTRA = {"twice": "SELECT max(doc_id) AS idx FROM $labels", "stray": "SELECT max(doc_id) + 1 AS idx FROM $labels"}


def _guard_preds(case: str) -> str:
    extra = f" UNION ALL {_GUARD_EXTRA[case]}" if case in _GUARD_EXTRA else ""
    return f"SELECT idx, 'E' AS pred FROM (SELECT doc_id AS idx FROM $labels WHERE {_GUARD_CASES[case]}{extra}) given"


def alignment_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guards say to predictions that lack rows, repeat one, or belong to none."""
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    reports = [
        scoring.alignment_report(gold, derive(spark, sf_dir, _guard_preds(case))).select(F.lit(case).alias("case"), "*")
        for case in _GUARD_CASES
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2]).unionByName(reports[3])


def _guard_sql(case: str) -> str:
    return f"""SELECT '{case}' AS "case", n_gold, n_pred, n_stray, n_twice,
  CASE WHEN n_pred > n_gold THEN {{text}} ELSE {{rest}} END AS lenient, CASE WHEN n_pred <> n_gold THEN {{text}} ELSE {{rest}} END AS strict
FROM (SELECT (SELECT count(*) FROM labels) AS n_gold, CAST(count(*) AS BIGINT) AS n_pred,
    CAST(count(*) FILTER (idx NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS n_stray,
    CAST(count(*) - count(DISTINCT idx) AS BIGINT) AS n_twice FROM ({plain(_guard_preds(case))}) preds)""".format(
        text="concat(n_pred, ' predictions for ', n_gold, ' rows')",
        rest="CASE WHEN n_stray > 0 THEN 'predictions without a gold row' WHEN n_twice > 0 THEN 'rows predicted more than once' END",
    )


ALIGNMENT_GUARDS = " UNION ALL ".join(_guard_sql(case) for case in _GUARD_CASES)


def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that passed its row-count expectation; a wrong number raises."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    # the labelled documents and the others, counted apart, are as many as there are to be
    n = labels.count() + docs.select("doc_id").join(labels, "doc_id", "left_anti").count()
    return checks.expect_at_least(checks.expect_rows(docs, n), n).groupBy("lang").agg(F.count("*").alias("n"))


EXPECTED_ROWS = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric documents of the three scorers, written and read back."""
    runs = {
        "extraction": scores._extraction(spark, sf_dir),
        "relevance": scores._relevance(spark, sf_dir),
        "detection": scores._detection(spark, sf_dir),
    }
    merged = None
    for task, (gold, preds) in runs.items():
        path = fresh_path(spark, "metrics")
        writers.write_document(score(gold, preds, task), path)
        stored = spark.read.text(path).select(F.lit(task).alias("task"), F.col("value").alias("metrics"))
        merged = stored if merged is None else merged.unionByName(stored)
    return merged


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = report.primary_metric(_documents(spark, sf_dir))
    n = F.get_json_object("metrics", "$.n_scored").cast("bigint").alias("n_scored")
    return primary.select("task", F.round("metric", 9).alias("metric"), n)


REPORT_ROUNDTRIP = f"""
SELECT 'extraction' AS task, f1 AS metric, n_scored FROM ({scores.EXTRACTION_SCORE})
UNION ALL SELECT 'relevance', macro_f1, n_scored FROM ({scores.RELEVANCE_SCORE})
UNION ALL SELECT 'detection', auroc_all, n_scored FROM ({scores.DETECTION_REPORT})"""

LIMITS = (("extraction", 0.1, 1.0), ("relevance", 0.25, 1.0), ("detection", 0.5, 1.0))


def normalised_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    # gains of the metrics as reported, to nine digits
    limits = spark.createDataFrame(LIMITS, "task STRING, trivial DOUBLE, perfect DOUBLE")
    reported = report.primary_metric(_documents(spark, sf_dir)).withColumn("metric", F.round("metric", 9))
    gains = report.normalized_gain(reported, limits)
    return gains.select("task", F.round("gain", 9).alias("gain"))


NORMALISED_GAIN = f"""
WITH m AS ({REPORT_ROUNDTRIP}), l AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {a}::DOUBLE, {b}::DOUBLE)" for t, a, b in LIMITS)}) v(task, trivial, perfect))
SELECT task, round((metric - trivial) / (perfect - trivial), 9) AS gain FROM m JOIN l USING (task)"""


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per document: its task decides where the primary number is found."""
    value = F.concat(F.lit("0."), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"))
    task = F.when(F.col("lang") == "en", "extraction").when(F.col("lang") == "fr", "relevance").when(F.col("lang") == "de", "detection").otherwise("other")
    document = (
        F.when(F.col("lang") == "en", F.concat(F.lit('{"f1": '), value, F.lit(', "macro_f1": 9}')))
        .when(F.col("lang") == "fr", F.concat(F.lit('{"micro_f1": 1, "macro_f1": '), value, F.lit("}")))
        .otherwise(F.concat(F.lit('{"score_agg": {"all": {"auroc": '), value, F.lit("}}}")))
    )
    runs = table(spark, sf_dir, "documents").select("doc_id", task.alias("task"), document.alias("metrics"))
    return report.primary_metric(runs).select("doc_id", "task", "metric")


LEADERBOARD = """
SELECT doc_id, CASE lang WHEN 'en' THEN 'extraction' WHEN 'fr' THEN 'relevance' WHEN 'de' THEN 'detection' ELSE 'other' END AS task,
  CASE WHEN lang IN ('en', 'fr', 'de') THEN CAST('0.' || lpad(CAST(n_chars % 1000 AS VARCHAR), 3, '0') AS DOUBLE) END AS metric FROM documents"""


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(*scores._relevance(spark, sf_dir), "relevance")
    return report.long_metrics(scored, "r1").withColumn("value", F.round("value", 9))


METRICS_LONG = f"""
WITH s AS ({scores.RELEVANCE_SCORE})
SELECT 'r1' AS run, 'micro_f1' AS metric, micro_f1 AS value FROM s UNION ALL SELECT 'r1', 'macro_f1', macro_f1 FROM s
UNION ALL SELECT 'r1', 'n_scored', n_scored::DOUBLE FROM s"""


def agent_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result document of an agent run: ledger cost (a missing price is recorded) and scores."""
    calls = with_usage(derive(spark, sf_dir, inputs.CALLS).where("status_code = 200"), "body")
    billed = calls.where("usage IS NOT NULL").withColumn("mtok", cost.mtok_cost(F.col("usage")))
    prices = spark.createDataFrame(
        [("click", "t", 2.0, 10.0, 0.2, 2.5, None), ("view", "t", 1.0, 1.0, 1.0, 1.0, None)], schemas.PRICES
    )
    gold, preds = scores._relevance(spark, sf_dir)
    document = agent_run.post_run(billed, prices, gold, preds, "relevance")

    def read(path: str) -> F.Column:
        return F.get_json_object("metrics", path)

    return document.select(
        F.round(read("$.macro_f1").cast("double"), 9).alias("macro_f1"), F.round(read("$.cost.mtok").cast("double"), 6).alias("mtok"),
        read("$.cost.usd").cast("double").alias("usd"), read("$.cost.usd_error").alias("usd_error"),
        read("$.out_txt_exists").alias("out_txt_exists"),
    )


AGENT_RESULT = f"""
WITH b AS (SELECT *, CASE WHEN event_type IN ('click', 'view') OR k >= 40 THEN c + 10 * k * 2 + 14 + 2 * k + k * 0.1 END AS units
  FROM (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events)
  WHERE event_type IN ('click', 'view', 'purchase'))
SELECT (SELECT macro_f1 FROM ({scores.RELEVANCE_SCORE})) AS macro_f1, round(CAST(sum(units) / 1e6 AS DOUBLE), 6) AS mtok, NULL::DOUBLE AS usd,
  'no rates for model purchase' AS usd_error, 'true' AS out_txt_exists FROM b"""


def run_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics document of a run within its budget: scores and summed cost."""
    gold, preds = scores._relevance(spark, sf_dir)
    spent = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.lit("0.000001").cast(cost.MTOK).alias("mtok"), F.lit(0.5).alias("usd"), F.lit(0.25).alias("walltime_min")
    )
    document = labelling.run_metrics(gold, preds.join(spent, "idx"), "relevance", budget=1000)
    return document.select(
        F.round(F.get_json_object("metrics", "$.micro_f1").cast("double"), 9).alias("micro_f1"),
        F.round(F.get_json_object("metrics", "$.cost.mtok").cast("double"), 6).alias("mtok"),
        F.get_json_object("metrics", "$.cost.usd").cast("double").alias("usd"),
        F.get_json_object("metrics", "$.walltime_min").cast("double").alias("walltime_min"),
    )


RUN_DOCUMENT = f"""
SELECT (SELECT micro_f1 FROM ({scores.RELEVANCE_SCORE})) AS micro_f1, round(count(*) / 1e6::DOUBLE, 6) AS mtok, count(*) * 0.5::DOUBLE AS usd,
  count(*) * 0.25::DOUBLE AS walltime_min FROM ({plain(inputs.RELEVANCE_PREDS)})"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per source: its text length as the loss."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum("n_chars").cast("double").alias("eval_loss"), F.min("doc_id").alias("seq")).select(
        "seq", F.lit(1e-5).alias("learning_rate"), "eval_loss", F.col("source").alias("student_dir"), F.lit(1.0).alias("walltime_min")
    )


def sweep_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection document of a sweep."""
    document = training.selection_summary(_sweep(spark, sf_dir))
    return document.select(
        F.get_json_object("metrics", "$.selected.student_dir").alias("student_dir"),
        F.get_json_object("metrics", "$.selected.eval_loss").cast("double").alias("eval_loss"),
        F.get_json_object("metrics", "$.n_points").cast("bigint").alias("n_points"),
    )


def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the same sweep as rows, the best one marked."""
    return training.selection_rows(_sweep(spark, sf_dir)).select("seq", "student_dir", "eval_loss", "selected")


SWEEP_ROWS = """
WITH p AS (SELECT source, sum(n_chars)::DOUBLE AS eval_loss, min(doc_id) AS seq FROM documents GROUP BY source)
SELECT seq, source AS student_dir, eval_loss, row_number() OVER (ORDER BY eval_loss, seq) = 1 AS selected FROM p"""


SWEEP_SELECTION = """
WITH p AS (SELECT source, sum(n_chars)::DOUBLE AS eval_loss, min(doc_id) AS seq FROM documents GROUP BY source)
SELECT source AS student_dir, eval_loss, (SELECT count(*) FROM p) AS n_points FROM p ORDER BY eval_loss, seq LIMIT 1"""

QUERIES = {
    "count_guards": (count_guards, COUNT_GUARDS),
    "alignment_guards": (alignment_guards, ALIGNMENT_GUARDS),
    "expected_rows": (expected_rows, EXPECTED_ROWS),
    "report_roundtrip": (report_roundtrip, REPORT_ROUNDTRIP),
    "normalised_gain": (normalised_gain, NORMALISED_GAIN),
    "leaderboard": (leaderboard, LEADERBOARD),
    "metrics_long": (metrics_long, METRICS_LONG),
    "agent_result": (agent_result, AGENT_RESULT),
    "run_document": (run_document, RUN_DOCUMENT),
    "sweep_selection": (sweep_selection, SWEEP_SELECTION),
    "sweep_rows": (sweep_rows, SWEEP_ROWS),
}
