"""Usage, cost, ledger and batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs
from catalog.base import derive, plain, table
from gradeline import schemas
from gradeline.functions.requests import apply_reasoning
from gradeline.functions.usage import annotate_body, billed_usage, usage_document, with_usage
from gradeline.operators import audit, batch, cost, ledger, routing
from gradeline.session import fresh_path, pin
from gradeline.sources import readers, writers

COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
BUDGET = "0.15"

# (model, tag, input, output, cache read, 5 m write, 1 h write); NULL is a blank cell
PRICES = (
    ("click", "t", 2.0, 10.0, 0.2, 2.5, 4.0),
    ("view", "t", 0.25, 1.5, 0.025, 0.3333333333333333, None),
    ("purchase", "t", 1.4, 4.4, 0.26, None, None),
    ("signup", "t", 0.15, 0.5, 0.03, None, None),
)
ROUTES = (("click", "maker/click-1", "p1"), ("view", "maker/view-1", "p2"), ("signup", "maker/signup-1", "p1"),
          ("purchase", "maker/purchase-1", "p3"), ("error", "maker/error-1", "p4"))


def _prices(spark: SparkSession) -> DataFrame:
    """The price table, through its CSV form."""
    path = fresh_path(spark, "prices")
    spark.createDataFrame(PRICES, schemas.PRICES).write.option("header", True).csv(path)
    return readers.read_prices(spark, path)


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, schemas.ROUTES)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_usage(derive(spark, sf_dir, inputs.CALLS), "body")


def _billed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their exact cost; failed calls and calls without usage cost NULL."""
    paid = F.when(F.col("status_code") == 200, cost.mtok_cost(F.col("usage")))
    return _calls(spark, sf_dir).withColumn("mtok", paid)


# The oracle parses the bodies too: the whole body, or the last data line that carries something.
_CALLS_CTE = f"""
WITH calls AS ({plain(inputs.CALLS)}),
docs AS (SELECT *, CASE WHEN body LIKE '{{%' THEN body ELSE substr(list_filter(string_split(body, chr(10)),
    lambda x: starts_with(x, 'data: ') AND trim(substr(x, 7)) NOT IN ('', '[DONE]'))[-1], 7) END AS doc FROM calls),
raw AS (SELECT *, json_extract(doc, '$.usage') AS u FROM docs),
nums AS (SELECT *, CAST(json_extract(u, '$.prompt_tokens') AS BIGINT) AS p, CAST(json_extract(u, '$.completion_tokens') AS BIGINT) AS o,
  CAST(json_extract(u, '$.prompt_tokens_details.cached_tokens') AS BIGINT) AS r,
  CAST(json_extract(u, '$.prompt_tokens_details.cache_write_tokens') AS BIGINT) AS w FROM raw),
used AS (SELECT *, p - r - w AS i FROM nums),
billed AS (SELECT *, CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN (i * 1.0::DECIMAL(6,3) + o * 2.0::DECIMAL(6,3) + w * 1.0::DECIMAL(6,3) + r * 0.1::DECIMAL(6,3))
    * 0.000001::DECIMAL(7,6) END AS any_mtok FROM used),
paid AS (SELECT *, CASE WHEN status_code = 200 THEN CAST(any_mtok AS DECIMAL(38,9)) END AS mtok FROM billed)"""


def _num(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 9).alias(c)


def _num_sql(c: str, name: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE), 9) AS {name or c}"


# ---- usage and cost -------------------------------------------------------------------------


def usage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("idx", *[F.col("usage")[c].alias(c) for c in COUNTERS], "usage_reason")


USAGE_PARSE = f"""{_CALLS_CTE}
SELECT idx, CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN i END AS input_tokens,
  CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN o END AS output_tokens,
  CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN r END AS cache_read_input_tokens,
  CASE WHEN i IS NOT NULL AND o IS NOT NULL THEN w END AS cache_creation_input_tokens,
  CASE WHEN body = '' THEN 'empty body' WHEN u IS NULL THEN 'usage missing' WHEN i IS NULL OR o IS NULL THEN 'usage incomplete' END AS usage_reason
FROM used"""


def mtok_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights through their CSV form."""
    path = fresh_path(spark, "weights")
    rows = [(c, float(w), "") for c, w in cost.MTOK_WEIGHTS.items()]
    spark.createDataFrame(rows, schemas.WEIGHTS).write.option("header", True).csv(path)
    weights = cost.weights_of(readers.read_weights(spark, path))
    return _calls(spark, sf_dir).withColumn("mtok", cost.mtok_cost(F.col("usage"), weights)).select("idx", _num("mtok"))


MTOK_COST = f"{_CALLS_CTE} SELECT idx, {_num_sql('any_mtok', 'mtok')} FROM billed"


def usd_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = cost.with_usd_cost(_calls(spark, sf_dir), _prices(spark), strict=False)
    return priced.select("idx", _num("usd"), "usd_error")


def _price_values() -> str:
    cells = ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")"
        for row in PRICES
    )
    return f"(VALUES {cells}) price(model, tag, pi, po, pr, pw, ph)"


_USD_CTE = f"""{_CALLS_CTE},
priced AS (SELECT b.*, CASE WHEN any_mtok IS NULL THEN NULL
    WHEN price.model IS NULL THEN 'no rates for model ' || b.model
    WHEN pw IS NULL AND w > 0 THEN b.model || ': cache_creation_input_tokens without 5m_cache_write_per_mtok' END AS usd_error,
  (i * pi + o * po + r * pr + CASE WHEN pw IS NULL THEN 0 ELSE w * pw END) / 1e6 AS raw_usd
  FROM paid b LEFT JOIN {_price_values()} ON price.model = b.model)"""

USD_COST = f"""{_USD_CTE}
SELECT idx, CASE WHEN usd_error IS NULL AND any_mtok IS NOT NULL THEN round(raw_usd, 9) END AS usd, usd_error FROM priced"""


def price_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls counted per published rate of their model: the long form of the price table."""
    rates = cost.rates_long(_prices(spark))
    calls = derive(spark, sf_dir, inputs.CALLS).groupBy("model").agg(F.count("*").alias("n_calls"))
    return calls.join(rates, "model").select("model", "rate", _num("usd_per_mtok"), "n_calls")


PRICE_RATES = f"""
WITH n AS (SELECT event_type AS model, count(*) AS n_calls FROM events GROUP BY 1), p AS (SELECT * FROM {_price_values()}),
long AS (SELECT model, 'base_input_per_mtok' AS rate, pi AS usd_per_mtok FROM p UNION ALL SELECT model, 'output_per_mtok', po FROM p
  UNION ALL SELECT model, 'cache_hit_refresh_per_mtok', pr FROM p UNION ALL SELECT model, '5m_cache_write_per_mtok', pw FROM p
  UNION ALL SELECT model, '1h_cache_write_per_mtok', ph FROM p)
SELECT long.model, rate, round(usd_per_mtok, 9) AS usd_per_mtok, n_calls FROM long JOIN n ON n.model = long.model WHERE usd_per_mtok IS NOT NULL"""


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = cost.with_usd_cost(_billed(spark, sf_dir), _prices(spark), strict=False)
    totals = cost.run_totals(priced, "model")
    return totals.select("model", _num("mtok"), F.round("usd", 6).alias("usd"), "usd_error", F.round("walltime_min", 6).alias("walltime_min"))


RUN_TOTALS = f"""{_USD_CTE}
SELECT model, {_num_sql('sum(mtok)', 'mtok')},
  CASE WHEN count(usd_error) = 0 THEN round(sum(CASE WHEN any_mtok IS NOT NULL THEN raw_usd END), 6) END AS usd,
  min(usd_error) AS usd_error, round(sum(walltime_min), 6) AS walltime_min FROM priced GROUP BY model"""


def billed_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with the billed usage attached, read back from the annotated text."""
    calls = _billed(spark, sf_dir)
    billed = F.when(F.col("mtok").isNotNull(), billed_usage(F.col("usage"), F.col("mtok")))
    annotated = calls.withColumn("annotated", annotate_body(F.col("body"), billed))
    document = usage_document(F.col("annotated"))

    def read(name: str) -> F.Column:
        value = F.get_json_object(document, f"$.harness_billed_usage.{name}").cast("double")
        return F.round(value, 9).alias(name)

    return annotated.select(
        "idx", read("input_mtok"), read("output_mtok"), read("cache_read_input_mtok"), read("cache_creation_input_mtok"),
        read("total_cost_mtok"),
        F.get_json_object(document, "$.usage.prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.md5(F.regexp_replace("annotated", ', "harness_billed_usage": \\{[^}]*\\}', "")).alias("rest_md5"),
    )


BILLED_ANNOTATION = f"""{_CALLS_CTE}
SELECT idx, CASE WHEN mtok IS NOT NULL THEN round(i / 1e6, 9) END AS input_mtok, CASE WHEN mtok IS NOT NULL THEN round(o / 1e6, 9) END AS output_mtok,
  CASE WHEN mtok IS NOT NULL THEN round(r / 1e6, 9) END AS cache_read_input_mtok,
  CASE WHEN mtok IS NOT NULL THEN round(w / 1e6, 9) END AS cache_creation_input_mtok, {_num_sql('mtok', 'total_cost_mtok')},
  p AS prompt_tokens, md5(body) AS rest_md5 FROM paid"""


def reasoning_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    payload = (
        F.when(F.col("event_type") == "click", '{"model": "m", "reasoning_effort": "high"}')
        .when(F.col("event_type") == "view", '{"model": "m", "reasoning_effort": "high", "reasoning": {"effort": "low"}}')
        .otherwise('{"model": "m"}')
    )
    request = apply_reasoning(F.from_json(payload, schemas.REQUEST))
    return events.select("event_id", F.to_json(request).alias("body"))


REASONING_NORMALISE = """
SELECT event_id, CASE event_type WHEN 'click' THEN '{"model":"m","reasoning":{"effort":"high"}}'
  WHEN 'view' THEN '{"model":"m","reasoning":{"effort":"low"}}' ELSE '{"model":"m"}' END AS body FROM events"""


# ---- routes ---------------------------------------------------------------------------------


def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derive(spark, sf_dir, inputs.CALLS)
    return routing.resolve_routes(calls, _routes(spark)).select("idx", "slug", "provider")


_ROUTE_VALUES = "(VALUES " + ", ".join(str(r) for r in ROUTES) + ") route(model, slug, provider)"
ROUTE_LOOKUP = f"SELECT event_id AS idx, slug, provider FROM events JOIN {_ROUTE_VALUES} ON model = event_type"


def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they are forwarded."""
    calls = derive(spark, sf_dir, inputs.CALLS)
    text = F.concat(F.lit('{"model": "'), "model", F.lit('", "max_tokens": 5, "reasoning_effort": "low"}'))
    ready = routing.rewrite_requests(calls.select("idx", F.from_json(text, schemas.REQUEST).alias("request")), _routes(spark))
    return ready.select("idx", F.to_json("request").alias("body"))


ROUTED_REQUESTS = f"""
SELECT event_id AS idx, '{{"model":"' || slug || '","max_tokens":5,"reasoning":{{"effort":"low"}},"provider":{{"only":["' || provider ||
  '"],"allow_fallbacks":false}}}}' AS body FROM events JOIN {_ROUTE_VALUES} ON model = event_type"""


def allowed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that calls used often enough and that have a route."""
    calls = derive(spark, sf_dir, inputs.CALLS)
    allowed = calls.groupBy("model").agg(F.max("k").alias("k")).where("k >= 10")
    routes = _routes(spark).where(F.col("provider") != "p4")
    return routing.usable_models(allowed, routes)


ALLOWED_MODELS = f"""
SELECT DISTINCT event_type AS model FROM events WHERE event_type IN (SELECT model FROM {_ROUTE_VALUES} WHERE provider <> 'p4')"""


# ---- ledger ---------------------------------------------------------------------------------


def _ledger(spark: SparkSession, sf_dir: str, run: str = "run") -> DataFrame:
    calls = _billed(spark, sf_dir).select("idx", run, "ts", "mtok")
    return ledger.running_ledger(calls, BUDGET, ["ts", "idx"], run=run)


def running_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select(
        "idx", "run", _num("spent_before"), _num("spent_after"), _num("remaining"), "exhausted"
    )


def _ledger_cte(run: str) -> str:
    return f"""{_CALLS_CTE},
spent AS (SELECT *, sum(coalesce(mtok, 0)) OVER (PARTITION BY {run} ORDER BY ts, idx) AS spent_after FROM paid),
led AS (SELECT *, spent_after - coalesce(mtok, 0) AS spent_before, {BUDGET} - spent_after AS remaining, spent_after >= {BUDGET} AS exhausted FROM spent)"""


RUNNING_LEDGER = f"""{_ledger_cte('run')}
SELECT idx, run, {_num_sql('spent_before')}, {_num_sql('spent_after')}, {_num_sql('remaining')}, exhausted FROM led"""


def ledger_hot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one run per model, so that each run is a fifth of the log."""
    return _ledger(spark, sf_dir, run="model").select("idx", "model", _num("spent_before"), _num("spent_after"), "exhausted")


LEDGER_HOT_RUNS = f"""{_ledger_cte('model')}
SELECT idx, model, {_num_sql('spent_before')}, {_num_sql('spent_after')}, exhausted FROM led"""


def first_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = _ledger(spark, sf_dir)
    return ledger.first_exhausted(spent, BUDGET).select("run", "idx", _num("spent_after"))


FIRST_EXHAUSTED = f"""{_ledger_cte('run')}
SELECT run, idx, {_num_sql('spent_after')} FROM led WHERE spent_before < {BUDGET} AND spent_after >= {BUDGET}"""



def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per model; the event id is the row's position."""
    records = pin(_billed(spark, sf_dir).select("idx", "model", "mtok"), "records")
    kept = ledger.budget_cut(records, "10", run="model", initial="0.25")
    return kept.select("idx", "model", _num("spent_after"), "stopped_early")


BUDGET_CUT = f"""{_CALLS_CTE},
spent AS (SELECT *, 0.25 + sum(coalesce(mtok, 0)) OVER (PARTITION BY model ORDER BY idx) AS spent_after FROM paid)
SELECT idx, model, {_num_sql('spent_after')}, spent_after >= 10 AS stopped_early FROM spent WHERE spent_after - coalesce(mtok, 0) < 10"""


_LINE_CALLS = """
SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS run, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n,
  l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS price,
  CASE WHEN l_quantity > 2 THEN CAST(round(l_extendedprice * 100) AS DECIMAL(18,0)) / 100000000 END AS mtok
FROM $lineitem"""


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as calls, half of them without a run: they are one run of their own."""
    calls = derive(spark, sf_dir, _LINE_CALLS).withColumn("mtok", F.col("mtok").cast(cost.MTOK))
    done = ledger.running_ledger(calls, "9", ["o", "n", "part", "supplier", "price"])
    return done.select("run", "o", "n", "part", "supplier", "price", _num("spent_before"), _num("spent_after"), "exhausted")


LEDGER_LINES = f"""
WITH calls AS ({plain(_LINE_CALLS)}),
spent AS (SELECT *, sum(coalesce(CAST(mtok AS DECIMAL(28,9)), 0)) OVER (PARTITION BY run ORDER BY o, n, part, supplier, price) AS spent_after FROM calls)
SELECT run, o, n, part, supplier, price, {_num_sql('spent_after - coalesce(CAST(mtok AS DECIMAL(28,9)), 0)', 'spent_before')}, {_num_sql('spent_after')},
  spent_after >= 9 AS exhausted FROM spent"""


_ORDER_CALLS = """
SELECT o_orderkey AS idx, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS run,
  CAST(CAST(round(o_totalprice * 100) AS DECIMAL(18,0)) / 1000000000 AS DECIMAL(28,9)) AS mtok FROM $orders"""


def budget_cut_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, a third of them without a run, cut at a budget."""
    return ledger.budget_cut(pin(derive(spark, sf_dir, _ORDER_CALLS), "records"), "5").select(
        "idx", "run", _num("spent_after"), "stopped_early"
    )


BUDGET_CUT_ORDERS = f"""
WITH calls AS ({plain(_ORDER_CALLS)}),
spent AS (SELECT *, sum(coalesce(mtok, 0)) OVER (PARTITION BY run ORDER BY idx) AS spent_after FROM calls)
SELECT idx, run, {_num_sql('spent_after')}, spent_after >= 5 AS stopped_early FROM spent WHERE spent_after - coalesce(mtok, 0) < 5"""


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.budget_status(_billed(spark, sf_dir), BUDGET)
    return out.select("run", _num("spent_mtok"), _num("budget_mtok"), _num("remaining_mtok"), "exhausted")


BUDGET_STATUS = f"""{_CALLS_CTE}
SELECT run, {_num_sql('coalesce(sum(mtok), 0)', 'spent_mtok')}, {BUDGET}::DOUBLE AS budget_mtok,
  {_num_sql(f'{BUDGET} - coalesce(sum(mtok), 0)', 'remaining_mtok')}, coalesce(sum(mtok), 0) >= {BUDGET} AS exhausted FROM paid GROUP BY run"""

_EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derive(spark, sf_dir, inputs.CALLS).withColumn("time", F.expr(_EPOCH) / 1e6)
    out = ledger.time_status(calls, 60000)
    return out.select(
        "run", "total_time_budget_min", F.round("used_time_min", 4).alias("used_time_min"),
        F.round("remaining_time_min", 4).alias("remaining_time_min"),
    )


TIME_BUDGET = """
SELECT CAST(user_id AS VARCHAR) AS run, 60000::DOUBLE AS total_time_budget_min,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 6e7, 4) AS used_time_min,
  round(60000 - (max(epoch_us(ts)) - min(epoch_us(ts))) / 6e7, 4) AS remaining_time_min FROM events GROUP BY 1"""


# ---- batch results --------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results through their file form: results exploded and keyed by custom id."""
    path = fresh_path(spark, "batch")
    raw = derive(spark, sf_dir, inputs.BATCH_RESULTS)
    line = F.concat(
        F.lit('{"id": "b", "status": "completed", "results": [{"custom_id": "'), F.col("idx").cast("string"),
        F.lit('", "response": '), "response", F.lit("}]}"),
    )
    raw.select(line.alias("value")).write.text(path)
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))
    return batch.join_results(asked, readers.read_batch_results(spark, path))


_JUDGED_CTE = f"""
WITH results AS ({plain(inputs.BATCH_RESULTS)}),
parsed AS (SELECT event_id AS idx, response, json_extract(response, '$.status_code')::INTEGER AS status,
  json_extract(response, '$.body.error.metadata.flagged_input') IS NOT NULL AS flagged,
  json_extract_string(response, '$.body.choices[0].finish_reason') AS finish,
  json_extract_string(response, '$.body.choices[0].message.content') AS content
  FROM events LEFT JOIN results ON idx = event_id),
judged AS (SELECT *, CASE WHEN response IS NULL THEN 'missing' WHEN status = 403 AND flagged THEN 'keep' WHEN status <> 200 THEN 'error'
  WHEN finish = 'length' THEN 'truncated' ELSE 'keep' END AS verdict FROM parsed)"""


def batch_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("idx", "verdict")


BATCH_TRIAGE = f"{_JUDGED_CTE} SELECT idx, verdict FROM judged"


def batch_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.status_counts(_judged(spark, sf_dir))


BATCH_STATUS_COUNTS = f"{_JUDGED_CTE} SELECT verdict, count(*) AS n FROM judged GROUP BY verdict"


def resend_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.to_resend(_judged(spark, sf_dir)).select("idx", "verdict")


RESEND_SET = f"{_JUDGED_CTE} SELECT idx, verdict FROM judged WHERE verdict <> 'keep'"


def resend_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeline.operators.sampling import preview

    return preview(batch.to_resend(_judged(spark, sf_dir)).select("idx", "verdict"))


RESEND_PREVIEW = f"{RESEND_SET} ORDER BY idx LIMIT 20"


def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept results as predictions; a response without content stands as its whole JSON."""
    kept = _judged(spark, sf_dir).where("verdict = 'keep'")
    records = batch.build_records(
        kept.select("idx", F.col("response.body").alias("response"), "raw")
    )
    return records.select("idx", F.md5("pred").alias("pred_md5"))


# the body stands as it was logged, between its key and the closing brace
_BODY_TEXT = "substr(response, strpos(response, '\"body\": ') + 8, length(response) - strpos(response, '\"body\": ') - 8)"
BATCH_PREDICTIONS = f"{_JUDGED_CTE} SELECT idx, md5(coalesce(content, {_BODY_TEXT})) AS pred_md5 FROM judged WHERE verdict = 'keep'"


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    return batch.pending(docs, done)


RESUME_PENDING = "SELECT doc_id AS idx, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return batch.resume_state(docs, labels, labels)


RESUME_STATE = """
SELECT (SELECT count(*) FROM documents) AS n_dataset, count(*) AS n_out, count(*) AS n_raw, NULL::VARCHAR AS problem FROM labels"""


def raw_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derive(spark, sf_dir, inputs.CALLS)
    return batch.keep_every(calls, 10).select("idx", "model")


RAW_EVERY = "SELECT event_id AS idx, event_type AS model FROM events WHERE event_id % 10 = 0"


def calls_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw call records through their file form: predictions and records written, records read back."""
    calls = derive(spark, sf_dir, inputs.CALLS)
    records = calls.select(
        "idx",
        F.struct(
            F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")),
                    F.struct(F.lit("user").alias("role"), F.col("run").alias("content"))).alias("messages"),
            F.col("model"), F.lit(64).alias("max_tokens"),
        ).alias("request"),
        F.struct(F.lit(0.0).alias("mtok"), F.lit(0.0).alias("usd")).alias("cost"), "walltime_min",
        F.from_json("body", schemas.RESPONSE).alias("response"),
    ).withColumn("pred", F.concat(F.lit("a\n"), F.col("request.model")))
    out, raw = fresh_path(spark, "out"), fresh_path(spark, "raw")
    writers.write_predictions(records, out, raw)
    back = readers.read_calls(spark, raw)
    metered = with_usage(back, "raw")
    return metered.select(
        "idx", F.col("request.model").alias("model"), F.col("request.messages")[1]["content"].alias("user"),
        F.round("walltime_min", 9).alias("walltime_min"), F.col("response.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.input_tokens").alias("input_tokens"),
    )


CALLS_SCAN = f"""{_CALLS_CTE}
SELECT idx, model, run AS user, round(walltime_min, 9) AS walltime_min, CASE WHEN body LIKE '{{%' THEN p END AS prompt_tokens,
  CASE WHEN body LIKE '{{%' AND o IS NOT NULL THEN i END AS input_tokens FROM used"""


def predictions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with line breaks written one per line in index order and read back by position."""
    from gradeline.operators.sampling import seeded_order

    docs = seeded_order(table(spark, sf_dir, "documents"), "doc_id", 11)
    out, raw = fresh_path(spark, "out"), fresh_path(spark, "raw")
    writers.write_predictions(docs.select("idx", F.col("text").alias("pred")), out, raw, raw_every=1000)
    back = readers.read_predictions(spark, out)
    return back.select("idx", F.md5("pred").alias("pred_md5"))


PREDICTIONS_FILE = """
SELECT row_number() OVER (ORDER BY md5(concat('11:', doc_id)), doc_id) - 1 AS idx,
  md5(CASE WHEN contains(text, chr(10)) THEN to_json(text)::VARCHAR ELSE text END) AS pred_md5 FROM documents"""


def request_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests judged with the balance their run had when they came in."""
    groups = [["blocked.example", "data"], ["nowhere.example"]]
    spent = _ledger(spark, sf_dir).select("idx", "spent_before")
    flagged = audit.with_url_flags(derive(spark, sf_dir, inputs.REQUESTS), groups)
    usable = routing.usable_models(_routes(spark).where("model <> 'error'"), _routes(spark))
    ready = audit.mark_allowed(flagged.join(spent, "idx"), usable)
    name, status = audit.verdict(F.col("key_ok"), F.col("spent_before") >= F.lit(BUDGET).cast(cost.MTOK), F.col("model_allowed"))
    return ready.select("idx", name.alias("verdict"), status.alias("status"))


REQUEST_VERDICT = f"""{_ledger_cte('run')},
req AS ({plain(inputs.REQUESTS)}),
j AS (SELECT q.*, led.spent_before, q.k >= 30 AND method = 'POST' AS chat FROM req q JOIN led ON led.idx = q.idx),
v AS (SELECT idx, CASE WHEN k < 8 THEN 'blocked' WHEN k < 18 THEN 'loopback' WHEN chat AND NOT key_ok THEN 'bad key'
  WHEN chat AND spent_before >= {BUDGET} THEN 'budget spent' WHEN chat AND model = 'error' THEN 'model not allowed' ELSE 'forward' END AS verdict FROM j)
SELECT idx, verdict, CASE verdict WHEN 'forward' THEN NULL WHEN 'budget spent' THEN 402 ELSE 403 END AS status FROM v"""

QUERIES = {
    "usage_parse": (usage_parse, USAGE_PARSE),
    "mtok_cost": (mtok_cost, MTOK_COST),
    "usd_cost": (usd_cost, USD_COST),
    "price_rates": (price_rates, PRICE_RATES),
    "run_totals": (run_totals, RUN_TOTALS),
    "billed_annotation": (billed_annotation, BILLED_ANNOTATION),
    "reasoning_normalise": (reasoning_normalise, REASONING_NORMALISE),
    "route_lookup": (route_lookup, ROUTE_LOOKUP),
    "routed_requests": (routed_requests, ROUTED_REQUESTS),
    "allowed_models": (allowed_models, ALLOWED_MODELS),
    "running_ledger": (running_ledger, RUNNING_LEDGER),
    "ledger_hot_runs": (ledger_hot_runs, LEDGER_HOT_RUNS),
    "first_exhausted": (first_exhausted, FIRST_EXHAUSTED),
    "budget_cut": (budget_cut, BUDGET_CUT),
    "ledger_lines": (ledger_lines, LEDGER_LINES),
    "budget_cut_orders": (budget_cut_orders, BUDGET_CUT_ORDERS),
    "budget_status": (budget_status, BUDGET_STATUS),
    "time_budget": (time_budget, TIME_BUDGET),
    "batch_triage": (batch_triage, BATCH_TRIAGE),
    "batch_status_counts": (batch_status_counts, BATCH_STATUS_COUNTS),
    "resend_set": (resend_set, RESEND_SET),
    "resend_preview": (resend_preview, RESEND_PREVIEW),
    "batch_predictions": (batch_predictions, BATCH_PREDICTIONS),
    "resume_pending": (resume_pending, RESUME_PENDING),
    "resume_state": (resume_state, RESUME_STATE),
    "raw_every": (raw_every, RAW_EVERY),
    "calls_scan": (calls_scan, CALLS_SCAN),
    "predictions_file": (predictions_file, PREDICTIONS_FILE),
    "request_verdict": (request_verdict, REQUEST_VERDICT),
}
