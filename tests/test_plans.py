import json

import pytest
from pyspark.sql import functions as F

from gradeline import schemas
from gradeline.functions.usage import with_usage
from gradeline.operators.cost import mtok_cost
from gradeline.plans import agent_run, labelling
from gradeline.plans.tasks import TASKS
from gradeline.sources.readers import parse_batch_results

USAGE = {"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 30, "cache_write_tokens": 20}}


def gold(spark, n=4):
    return spark.createDataFrame([(i, str(i), "Exact") for i in range(n)], "idx BIGINT, example_id STRING, label STRING")


def test_task_registry(spark):
    assert {n: t.metric_path for n, t in TASKS.items()} == {
        "extraction": "$.f1", "relevance": "$.macro_f1", "detection": "$.score_agg.all.auroc",
    }
    sample = spark.createDataFrame([(0, "q", "t", "1", "E", "us", 1, "train")], "idx BIGINT, query STRING, product_title STRING, example_id STRING, label STRING, locale STRING, large_version INT, split STRING")
    task = TASKS["relevance"]
    assert task.questions(sample).columns == ["idx", "query", "product_title"]
    assert task.gold(sample).columns == ["idx", "example_id", "label", "locale", "large_version", "split"]
    assert task.prompts(task.questions(sample)).first().prompt == '{"query":"q","product_title":"t"}'
    with pytest.raises(Exception, match="split"):
        task.gold(sample.drop("split")).collect()


def test_requests_for_remote_and_thinking(spark):
    questions = spark.createDataFrame([(0, "hello")], "idx BIGINT, text STRING")
    body = labelling.requests(questions, "detection", "slug", "sys", 9, "prov", "low").select(F.to_json("body")).first()[0]
    assert json.loads(body) == {
        "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": '{"text":"hello"}'}],
        "model": "slug", "max_tokens": 9, "provider": {"only": ["prov"], "allow_fallbacks": False}, "reasoning": {"effort": "low"},
    }


def test_local_labelling_marks_what_does_not_fit(spark):
    questions = spark.createDataFrame([(0, "a b"), (1, "a b c d e f")], "idx BIGINT, text STRING")
    rows = {r.idx: r for r in labelling.label_locally(questions, "detection", lambda: lambda p: [" 0.9\n"] * len(p), 5, 8).collect()}
    assert rows[0].pred == "0.9" and float(rows[0].mtok) == 0.0
    assert json.loads(rows[1].pred)["error"]["message"].startswith("prompt of 6 tokens")


def test_collect_batch(spark):
    asked = spark.range(3).select(F.col("id").alias("idx"), F.lit("b").alias("body"))
    answers = [
        (0, json.dumps({"status_code": 200, "body": {"choices": [{"message": {"content": " e "}}], "usage": USAGE}})),
        (1, json.dumps({"status_code": 500})),
    ]
    results = spark.createDataFrame(answers, "idx BIGINT, t STRING").select("idx", F.from_json("t", schemas.BATCH_RESULT).alias("response"), F.get_json_object("t", "$.body").alias("raw"))
    prices = spark.createDataFrame([("m", "t", 2.0, 10.0, 0.2, 2.5, None)], schemas.PRICES)
    records, resend = labelling.collect_batch(asked, results, "relevance", prices, "m")
    row = records.first()
    assert row.pred == "E" and row.usd == pytest.approx(0.000226)
    assert sorted(r.idx for r in resend.collect()) == [1, 2]


def test_batch_bodies_stay_whole(spark):
    body = {"id": "x", "provider": "p", "error": {"code": 403, "message": "no", "metadata": {"flagged_input": "y"}}}
    line = json.dumps({"id": "b", "results": [{"custom_id": "5", "response": {"status_code": 403, "body": body}}]})
    rows = spark.createDataFrame([(line,)], "t STRING").select(F.from_json("t", schemas.BATCH_RESULTS).alias("b")).select("b.*")
    asked = spark.range(5, 6).select(F.col("id").alias("idx"), F.lit("b").alias("body"))
    prices = spark.createDataFrame([("m", "t", 2.0, 10.0, 0.2, 2.5, None)], schemas.PRICES)
    records, _ = labelling.collect_batch(asked, parse_batch_results(rows), "relevance", prices, "m")
    assert json.loads(records.first().pred) == body


def run(spark, budget):
    rows = [(i, "E", 2.0, 0.5, 1.0) for i in range(4)]
    records = spark.createDataFrame(rows, "idx BIGINT, pred STRING, mtok DOUBLE, usd DOUBLE, walltime_min DOUBLE")
    document = labelling.run_metrics(gold(spark), records, "relevance", budget)
    return json.loads(document.first().metrics)


def test_run_metrics(spark):
    whole = run(spark, None)
    assert whole["macro_f1"] == 1.0 and whole["cost"] == {"mtok": 8.0, "usd": 2.0} and whole["walltime_min"] == 4.0
    assert run(spark, 100)["macro_f1"] == 1.0
    cut = run(spark, 5)
    assert "macro_f1" not in cut and cut["cost"] == {"mtok": 6.0, "usd": 1.5}


def test_post_run(spark):
    calls = with_usage(spark.createDataFrame([(json.dumps({"usage": USAGE}), m) for m in ("m", "m")], "body STRING, model STRING"))
    billed = calls.withColumn("mtok", mtok_cost(F.col("usage")))
    prices = spark.createDataFrame([("m", "t", 2.0, 10.0, 0.2, 2.5, None)], schemas.PRICES)
    preds = spark.createDataFrame([(0, "E")], "idx BIGINT, pred STRING")
    good = json.loads(agent_run.post_run(billed, prices, gold(spark), preds, "relevance").first().metrics)
    assert good["cost"]["usd"] == pytest.approx(0.000452) and good["out_txt_exists"] and "macro_f1" in good
    bad = json.loads(agent_run.post_run(billed.withColumn("model", F.lit("x")), prices, gold(spark), None, "relevance").first().metrics)
    assert bad["cost"]["usd_error"] == "no rates for model x" and "usd" not in bad["cost"] and not bad["out_txt_exists"]
    info = {"agent_returncode": 0, "walltime_min": 1.5}
    many = spark.createDataFrame([(i, "E") for i in range(9)], "idx BIGINT, pred STRING")
    failed = json.loads(agent_run.post_run(billed, prices, gold(spark), many, "relevance", info).first().metrics)
    assert "9 predictions for 4 rows" in failed["eval_error"] and failed["walltime_min"] == 1.5 and "usd" in failed["cost"]
