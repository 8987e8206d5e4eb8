import json

import pytest
from pyspark.sql import functions as F

from gradeline import schemas
from gradeline.functions.requests import apply_reasoning, first_turn
from gradeline.operators import batch, checks
from gradeline.sources.readers import parse_batch_results, parse_calls

RESULT = f"STRUCT<status_code: INT, body: {schemas.RESPONSE}>"


def answer(status, **body):
    return json.dumps({"status_code": status, "body": body})


def choice(content, finish):
    return [{"message": {"role": "assistant", "content": content}, "finish_reason": finish}]


CASES = [
    (None, "missing"), ("{}", "missing"),
    (answer(403, error={"message": "m", "metadata": {"flagged_input": "x"}}), "keep"),
    (answer(403, error={"message": "m", "metadata": {"flagged_input": None}}), "keep"),
    (answer(403, error={"message": "m", "metadata": {"other": "x"}}), "error"), (answer(403), "error"),
    (answer(500, error={"message": "m"}), "error"), (answer(200, choices=choice("a", "length")), "truncated"),
    (answer(200, choices=choice(None, "content_filter")), "keep"), (answer(200, choices=[]), "keep"),
    (answer(200, choices=choice("a", "stop")), "keep"), (answer(200), "keep"),
]


def test_triage(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i INT, t STRING")
    got = rows.select("i", batch.triage(F.from_json("t", RESULT)).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [v for _, v in CASES]


def test_resend_is_what_was_not_kept(spark):
    results = spark.createDataFrame([(1, answer(200, choices=choice("a", "stop"))), (2, answer(500))], "idx BIGINT, t STRING")
    judged = batch.join_results(spark.range(4).withColumnRenamed("id", "idx"), results.select("idx", F.from_json("t", RESULT).alias("response"), F.lit(None).cast("string").alias("raw")))
    assert sorted(r.idx for r in batch.to_resend(judged).collect()) == [0, 2, 3]
    assert {r.verdict: r.n for r in batch.status_counts(judged).collect()} == {"missing": 2, "error": 1, "keep": 1}


def test_results_are_keyed_by_custom_id(spark):
    text = json.dumps({"results": [{"custom_id": "7", "response": {"status_code": 200}}, {"custom_id": "3"}]})
    rows = spark.createDataFrame([(text,)], "t STRING").select(F.from_json("t", schemas.BATCH_RESULTS).alias("b")).select("b.*")
    got = {r.idx: r.response and r.response.status_code for r in parse_batch_results(rows).collect()}
    assert got == {7: 200, 3: None}


def records(spark, responses, prices=None):
    rows = spark.createDataFrame([(i, t, "m") for i, t in enumerate(responses)], "idx BIGINT, raw STRING, model STRING")
    answered = rows.withColumn("response", F.from_json("raw", schemas.RESPONSE))
    return batch.build_records(answered, prices).orderBy("idx").collect()


def test_a_reply_without_content_stays_whole(spark):
    responses = [json.dumps({"choices": choice("hi", "stop")}), json.dumps({"choices": choice(None, "x")}), '{"error": {"message": "m"}}', '{"choices": []}']
    got = [r.pred for r in records(spark, responses)]
    assert got == ["hi", *responses[1:]]


def test_records_are_billed_only_with_usage(spark):
    usage = {"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 30, "cache_write_tokens": 20}}
    prices = spark.createDataFrame([("m", "t", 2.0, 10.0, 0.2, 2.5, None)], schemas.PRICES)
    rows = records(spark, [json.dumps({"choices": choice("a", "stop"), "usage": usage}), json.dumps({"choices": []})], prices)
    assert float(rows[0].mtok) == pytest.approx(0.000087) and rows[0].usd == pytest.approx(0.000226)
    assert (float(rows[1].mtok), rows[1].usd) == (0.0, 0.0)
    unread = records(spark, [json.dumps({"choices": [], "usage": {"prompt_tokens": 5}})], prices)[0]
    assert (unread.mtok, unread.usd, unread.usage_reason) == (None, None, "usage incomplete")


def test_resume(spark):
    ids = spark.range(10).withColumnRenamed("id", "idx")
    done = ids.where("idx IN (0, 1, 5)")
    assert sorted(r.idx for r in batch.pending(ids, done).collect()) == [2, 3, 4, 6, 7, 8, 9]
    assert batch.resume_state(ids, done, done).first().problem is None
    assert batch.resume_state(ids, done, done.where("idx > 0")).first().problem == "out and raw differ"
    assert batch.resume_state(done, ids, ids).first().problem == "more predictions than rows"
    assert [r.idx for r in batch.keep_every(ids, 4).orderBy("idx").collect()] == [0, 4, 8]


def test_raw_calls_keep_the_response_text(spark):
    line = '{"idx": 3, "request": {"messages": [{"role": "user", "content": "q"}], "extra": 1}, "response": {"id": "z", "choices": []}}'
    row = parse_calls(spark.createDataFrame([(line,)], "value STRING")).first()
    assert row.idx == 3 and json.loads(row.raw) == {"id": "z", "choices": []}


def test_reasoning(spark):
    cases = [
        ('{"reasoning_effort": "high"}', "high"), ('{"reasoning_effort": "high", "reasoning": {"effort": "low"}}', "low"), ("{}", None),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i INT, t STRING")
    out = rows.select("i", apply_reasoning(F.from_json("t", schemas.REQUEST)).alias("r")).orderBy("i").collect()
    assert [r.r.reasoning and r.r.reasoning.effort for r in out] == [e for _, e in cases]
    assert "reasoning_effort" not in out[0].r.asDict()


def test_first_turn(spark):
    rows = spark.sql("SELECT array(named_struct('role','user','content','u1'), named_struct('role','user','content','u2')) AS m")
    got = rows.select(first_turn(F.col("m"), "user").alias("u"), first_turn(F.col("m"), "system").alias("s")).first()
    assert (got.u, got.s) == ("u1", None)


def test_expectations(spark):
    df = spark.range(5)
    assert checks.expect_rows(df, 5) is df and checks.expect_at_least(df, 5) is df
    with pytest.raises(ValueError, match="expected 6 rows, found 5"):
        checks.expect_rows(df, 6)
    with pytest.raises(ValueError, match="asked for 6"):
        checks.expect_at_least(df, 6)
