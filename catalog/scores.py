"""Scoring queries."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs
from catalog.base import derive, plain, table
from gradeline.functions.replies import detection_score, fallback_letter, relevance_letter
from gradeline.functions.text import normalize_answer
from gradeline.operators import detection as det, scoring
from gradeline.operators.sampling import fallback_labels
from gradeline.plans.tasks import TASKS, score
from gradeline.session import fresh_path
from gradeline.sources import stored
from gradeline.sources.writers import write_fallback_labels

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PUNCT = string.punctuation.replace("'", "''")


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def normalize_sql(x: str) -> str:
    """ASCII input only: the oracle's word edges and blanks are ASCII."""
    return (
        rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '{_PUNCT}', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def fallback_sql(key: str, seed: int = 0) -> str:
    return (
        f"(['E','S','C','I'])[CAST(('0x' || substr(md5(concat('{seed}:', {key})), 1, 8))::BIGINT % 4 + 1 AS INTEGER)]"
    )


# ---- answers --------------------------------------------------------------------------------


def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalize_answer(F.col("text"))).alias("answer_md5"))


# Letters, ASCII punctuation and whitespace are all the texts hold, so articles are whole tokens.
ANSWER_NORMALIZE = rf"""
SELECT doc_id, md5(array_to_string(list_filter(
  string_split_regex(translate(lower(text), '{_PUNCT}', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')) AS answer_md5
FROM documents"""


# ---- extraction -----------------------------------------------------------------------------


def _extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = derive(spark, sf_dir, inputs.EXTRACTION)
    values = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"))) for c in ("value_1", "value_2")])
    )
    return rows.select("idx", values.alias("evidences")), rows.select("idx", "pred")


def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, preds = _extraction(spark, sf_dir)
    return scoring.extraction_outcomes(gold.join(preds, "idx")).select("idx", "outcome")


def extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, preds = _extraction(spark, sf_dir)
    lines = preds.withColumn("pred", TASKS["extraction"].parse_reply(F.col("pred")))
    scored = score(gold, lines, "extraction")
    return scored.select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "n_scored", *scoring.OUTCOMES
    )


_OUTCOMES_CTE = f"""
WITH rows AS ({plain(inputs.EXTRACTION)}),
parsed AS (SELECT idx, list_filter([{normalize_sql('value_1')}, {normalize_sql('value_2')}], lambda x: x IS NOT NULL AND x <> '') AS gold,
  {strip_sql('pred')} AS bare FROM rows),
guessed AS (SELECT idx, gold, {normalize_sql("CASE WHEN bare = '<NO_VALUE>' THEN '' ELSE bare END")} AS guess FROM parsed),
measured AS (SELECT idx, CASE WHEN len(gold) = 0 AND guess = '' THEN 'n_n' WHEN len(gold) = 0 THEN 'n_a'
  WHEN guess = '' THEN 'a_n' WHEN list_contains(gold, guess) THEN 'a_a' ELSE 'a_b' END AS outcome FROM guessed)"""

EXTRACTION_OUTCOMES = f"{_OUTCOMES_CTE} SELECT idx, outcome FROM measured"

EXTRACTION_SCORE = f"""{_OUTCOMES_CTE},
c AS (SELECT count(*) AS n_scored, {', '.join(f"count(*) FILTER (outcome = '{m}') AS {m}" for m in scoring.OUTCOMES)} FROM measured),
pr AS (SELECT *, coalesce(a_a / nullif(n_a + a_a + a_b, 0), 0) AS p, coalesce(a_a / nullif(a_n + a_a + a_b, 0), 0) AS r FROM c)
SELECT round(CAST(p AS DOUBLE), 9) AS precision, round(CAST(r AS DOUBLE), 9) AS recall,
  round(CAST(coalesce(2 * p * r / nullif(p + r, 0), 0) AS DOUBLE), 9) AS f1, n_scored, {', '.join(scoring.OUTCOMES)} FROM pr"""


# ---- relevance ------------------------------------------------------------------------------


def _relevance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, inputs.RELEVANCE_GOLD), derive(spark, sf_dir, inputs.RELEVANCE_PREDS)


def relevance_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = derive(spark, sf_dir, inputs.RELEVANCE_REPLIES)
    return preds.select("idx", relevance_letter(F.col("pred")).alias("letter"))


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(*_relevance(spark, sf_dir), "relevance")
    return scored.select(
        F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"), "n_scored"
    )


def stored_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same score from gold and predictions that were stored by idx: the join moves neither."""
    gold, preds = _relevance(spark, sf_dir)
    found = stored.store_views({"gt": gold, "pred": preds}, f"v{uuid.uuid4().hex}", fresh_path(spark, "stored"))
    return score(found["gt"], found["pred"], "relevance").select(
        F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"), "n_scored"
    )


def relevance_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(scoring.relevance_predictions(*_relevance(spark, sf_dir)))


_LETTER = f"upper({strip_sql('pred')})"
_USABLE = f"{_LETTER} IN ('E','S','C','I')"
RELEVANCE_REPLIES = f"""
WITH preds AS ({plain(inputs.RELEVANCE_REPLIES)})
SELECT idx, CASE WHEN {_USABLE} THEN {_LETTER} ELSE '' END AS letter FROM preds"""

_PAIRS_CTE = f"""
WITH gold AS ({plain(inputs.RELEVANCE_GOLD)}), preds AS ({plain(inputs.RELEVANCE_PREDS)}),
letters AS (SELECT g.idx, label, CASE WHEN {_USABLE} THEN {_LETTER} ELSE {fallback_sql('example_id')} END AS letter
  FROM gold g LEFT JOIN preds p ON g.idx = p.idx),
pairs AS (SELECT idx, label, CASE letter WHEN 'E' THEN 'Exact' WHEN 'S' THEN 'Substitute' WHEN 'C' THEN 'Complement'
  ELSE 'Irrelevant' END AS predicted FROM letters)"""

RELEVANCE_CONFUSION = f"{_PAIRS_CTE} SELECT label, predicted, count(*) AS n FROM pairs GROUP BY ALL"

RELEVANCE_SCORE = f"""{_PAIRS_CTE},
classes AS (SELECT label AS name FROM pairs UNION SELECT predicted FROM pairs),
f AS (SELECT name, 2.0 * count(*) FILTER (label = name AND predicted = name)
    / (count(*) FILTER (label = name) + count(*) FILTER (predicted = name)) AS f1
  FROM classes JOIN pairs ON label = name OR predicted = name GROUP BY name)
SELECT round((SELECT avg(CAST(label = predicted AS INTEGER)) FROM pairs), 9) AS micro_f1,
  round(CAST(avg(f1) AS DOUBLE), 9) AS macro_f1, (SELECT count(*) FROM pairs) AS n_scored FROM f"""


def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback letters stored once and looked up by id."""
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "fallback")
    write_fallback_labels(fallback_labels(docs, "doc_id"), path)
    return docs.select("doc_id", "lang").join(spark.read.parquet(path), "doc_id", "left")


FALLBACK_LOOKUP = f"SELECT doc_id, lang, {fallback_sql('doc_id')} AS letter FROM documents"


def fallback_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fallback_letter(F.col("o_orderkey"), 3).alias("letter"))


FALLBACK_INLINE = f"SELECT o_orderkey, {fallback_sql('o_orderkey', 3)} AS letter FROM orders"


# ---- detection ------------------------------------------------------------------------------


def _detection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derive(spark, sf_dir, inputs.DETECTION_GOLD), derive(spark, sf_dir, inputs.DETECTION_PREDS)


def _histogram(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hist = det.histogram(det.score_rows(*_detection(spark, sf_dir)))
    return hist, det.human_ranks(hist)


def detection_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = derive(spark, sf_dir, inputs.DETECTION_REPLIES)
    return preds.select("idx", detection_score(F.col("pred")).alias("score"))


def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined to gold by document id."""
    gold, preds = _detection(spark, sf_dir)
    results = det.score_rows(gold, preds).select("id", "score")
    return det.results_by_id(gold, results).select("id", "model", "domain", "attack", "score")


def detection_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranks = _histogram(spark, sf_dir)
    out = det.auroc(ranks)
    return out.withColumn("auroc", F.round("auroc", 9))


def detection_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ranks = _histogram(spark, sf_dir)
    out = det.thresholds(ranks, det.scope_totals(ranks))
    return out.select("scope", *[F.round(c, 9).alias(c) for c in out.columns if c != "scope"])


def _grid(spark: SparkSession, sf_dir: str, tuned: bool) -> DataFrame:
    return _rounded(det.score_grid(*_histogram(spark, sf_dir), per_domain_tuning=tuned))


def _rounded(grid: DataFrame) -> DataFrame:
    rounded = [c for c in grid.columns if c.startswith("accuracy") or c == "auroc"]
    return grid.withColumns({c: F.round(c, 9) for c in rounded})


def detection_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, tuned=False)


def detection_slices_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, tuned=True)


def detection_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.headline(_grid(spark, sf_dir, tuned=False))


def detection_report_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice grid as it lies beside the metrics document, read back."""
    path = fresh_path(spark, "report")
    det.write_detection_report(*_detection(spark, sf_dir), path)
    return _rounded(spark.read.parquet(f"{path}/grid"))


def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(*_detection(spark, sf_dir), "detection")
    return out.select(
        F.round("score_agg.all.auroc", 9).alias("auroc_all"),
        F.round("score_agg.no_adversarial.auroc", 9).alias("auroc_no_adversarial"),
        F.round("score_agg.no_adversarial.accuracy_fpr_0_05", 9).alias("accuracy_no_adversarial"),
        F.round("thresholds.threshold_fpr_0_01", 9).alias("threshold_fpr_0_01"),
        "n_scored", "distinct_preds", "n_human", "n_machine", "per_domain_tuning",
    )


_BARE = strip_sql("coalesce(pred, '')")
_DIGITS = "[0-9](?:_?[0-9])*"
_FLOAT = f"(?i)[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:e[+-]?{_DIGITS})?"
_PARSED = f"CASE WHEN regexp_full_match({_BARE}, '{_FLOAT}') THEN TRY_CAST(replace({_BARE}, '_', '') AS DOUBLE) END"
_SCORE = f"CASE WHEN {_PARSED} BETWEEN 0 AND 1 THEN abs({_PARSED}) ELSE 0.5 END"

DETECTION_REPLIES = f"WITH preds AS ({plain(inputs.DETECTION_REPLIES)}) SELECT idx, {_SCORE} AS score FROM preds"

_SCORED_CTE = f"""
WITH gold AS ({plain(inputs.DETECTION_GOLD)}), preds AS ({plain(inputs.DETECTION_PREDS)}),
scored AS (SELECT g.*, {_SCORE} AS score FROM gold g LEFT JOIN preds p ON g.idx = p.idx)"""

DETECTION_ROWS = f"{_SCORED_CTE} SELECT id, model, domain, attack, score FROM scored"

DETECTION_AUROC = f"""{_SCORED_CTE},
h AS (SELECT score, count(*) FILTER (model = 'human') AS neg, count(*) FILTER (model <> 'human') AS pos FROM scored GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / nullif(2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0), 9) AS auroc,
  CAST(sum(pos + neg) AS BIGINT) AS n_scored, count(*) AS distinct_preds, CAST(sum(neg) AS BIGINT) AS n_human,
  CAST(sum(pos) AS BIGINT) AS n_machine FROM r"""

_SCOPES = """
scopes AS (SELECT 'all' AS scope, * FROM scored UNION ALL SELECT domain AS scope, * FROM scored),
totals AS (SELECT scope, count(*) FILTER (model = 'human') AS n_human FROM scopes GROUP BY scope),
points AS (SELECT scope, score, count(*) FILTER (model = 'human') AS neg FROM scopes GROUP BY scope, score),
ranks AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY scope ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM points),
shares AS (SELECT r.scope, score, (n_human - below)::DOUBLE / nullif(n_human, 0)::DOUBLE AS share, n_human FROM ranks r JOIN totals t ON r.scope = t.scope),
limits AS (SELECT scope,
  CASE WHEN max(n_human) > 0 THEN coalesce(min(score) FILTER (share <= 0.05::DOUBLE), 'inf'::DOUBLE) END AS t5,
  CASE WHEN max(n_human) > 0 THEN coalesce(max(share) FILTER (share <= 0.05::DOUBLE), 0) END AS a5,
  CASE WHEN max(n_human) > 0 THEN coalesce(min(score) FILTER (share <= 0.01::DOUBLE), 'inf'::DOUBLE) END AS t1,
  CASE WHEN max(n_human) > 0 THEN coalesce(max(share) FILTER (share <= 0.01::DOUBLE), 0) END AS a1
  FROM shares GROUP BY scope)"""

DETECTION_THRESHOLD = f"""{_SCORED_CTE}, {_SCOPES}
SELECT scope, round(t5, 9) AS threshold_fpr_0_05, round(a5, 9) AS achieved_fpr_0_05,
  round(t1, 9) AS threshold_fpr_0_01, round(a1, 9) AS achieved_fpr_0_01 FROM limits"""

_AXES = ", ".join(det.AXES)


def _grid_sql(tuned: bool) -> str:
    scope = "s.domain" if tuned else "'all'"
    named = ", ".join(f"CASE WHEN grouping({a}) = 1 THEN 'all' ELSE {a} END AS {a}" for a in det.AXES)
    return f"""{_SCORED_CTE}, {_SCOPES},
machine AS (SELECT s.*, 2 * ra.below + ra.neg AS u_all, 2 * rd.below + rd.neg AS u_dom,
    CAST(s.score >= l.t5 AS INTEGER) AS h5, CAST(s.score >= l.t1 AS INTEGER) AS h1
  FROM scored s JOIN ranks ra ON ra.scope = 'all' AND ra.score = s.score
  JOIN ranks rd ON rd.scope = s.domain AND rd.score = s.score JOIN limits l ON l.scope = {scope}
  WHERE model <> 'human'),
cells AS (SELECT {named}, count(*) AS n_machine, sum(h5) / count(*) AS accuracy_fpr_0_05, sum(h1) / count(*) AS accuracy_fpr_0_01,
  CASE WHEN grouping(domain) = 1 THEN sum(u_all) ELSE sum(u_dom) END AS u FROM machine GROUP BY CUBE ({_AXES})),
grid AS (SELECT {', '.join('c.' + a for a in det.AXES)}, n_machine, round(accuracy_fpr_0_05, 9) AS accuracy_fpr_0_05,
  round(accuracy_fpr_0_01, 9) AS accuracy_fpr_0_01,
  round(u::DOUBLE / nullif(2.0::DOUBLE * n_machine::DOUBLE * n_human::DOUBLE, 0), 9) AS auroc
  FROM cells c JOIN totals t ON c.domain = t.scope)"""


DETECTION_SLICES = f"{_grid_sql(False)} SELECT * FROM grid"
DETECTION_SLICES_TUNED = f"{_grid_sql(True)} SELECT * FROM grid"

_HEAD = f"""{_grid_sql(False)},
head AS (SELECT attack AS a, n_machine, accuracy_fpr_0_05, accuracy_fpr_0_01, auroc FROM grid
  WHERE domain = 'all' AND model = 'all' AND decoding = 'all' AND repetition_penalty = 'all' AND attack IN ('all', 'none'))"""

DETECTION_HEADLINE = f"""{_HEAD}
SELECT f.headline, n_machine, accuracy_fpr_0_05, accuracy_fpr_0_01, auroc, CASE WHEN n_machine IS NULL THEN f.note END AS note
FROM (VALUES ('all', 'all', '{det.NOTES["all"]}'), ('no_adversarial', 'none', '{det.NOTES["no_adversarial"]}')) f(headline, a, note)
LEFT JOIN head ON head.a = f.a"""

DETECTION_REPORT = f"""{_HEAD}
SELECT (SELECT auroc FROM head WHERE a = 'all') AS auroc_all, (SELECT auroc FROM head WHERE a = 'none') AS auroc_no_adversarial,
  (SELECT accuracy_fpr_0_05 FROM head WHERE a = 'none') AS accuracy_no_adversarial,
  (SELECT round(t1, 9) FROM limits WHERE scope = 'all') AS threshold_fpr_0_01,
  count(*) AS n_scored, count(DISTINCT score) AS distinct_preds, count(*) FILTER (model = 'human') AS n_human,
  count(*) FILTER (model <> 'human') AS n_machine, false AS per_domain_tuning FROM scored"""

QUERIES = {
    "answer_normalize": (answer_normalize, ANSWER_NORMALIZE),
    "extraction_outcomes": (extraction_outcomes, EXTRACTION_OUTCOMES),
    "extraction_score": (extraction_score, EXTRACTION_SCORE),
    "relevance_replies": (relevance_replies, RELEVANCE_REPLIES),
    "relevance_score": (relevance_score, RELEVANCE_SCORE),
    "stored_relevance": (stored_relevance, RELEVANCE_SCORE),
    "relevance_confusion": (relevance_confusion, RELEVANCE_CONFUSION),
    "fallback_lookup": (fallback_lookup, FALLBACK_LOOKUP),
    "fallback_inline": (fallback_inline, FALLBACK_INLINE),
    "detection_replies": (detection_replies, DETECTION_REPLIES),
    "detection_rows": (detection_rows, DETECTION_ROWS),
    "detection_auroc": (detection_auroc, DETECTION_AUROC),
    "detection_threshold": (detection_threshold, DETECTION_THRESHOLD),
    "detection_slices": (detection_slices, DETECTION_SLICES),
    "detection_report_grid": (detection_report_grid, DETECTION_SLICES),
    "detection_slices_tuned": (detection_slices_tuned, DETECTION_SLICES_TUNED),
    "detection_headline": (detection_headline, DETECTION_HEADLINE),
    "detection_report": (detection_report, DETECTION_REPORT),
}
