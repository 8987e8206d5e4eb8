import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeline.functions.usage import annotate_body, billed_usage, with_usage
from gradeline.operators import cost, routing

USAGE = {"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 30, "cache_write_tokens": 20}}
GOOD = json.dumps({"id": "x", "usage": USAGE})
CHUNK = "data: " + json.dumps({"usage": USAGE})


def parsed(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING")
    return with_usage(rows).orderBy("i").collect()


def without(*keys):
    usage = json.loads(json.dumps(USAGE))
    if keys[-1] in usage:
        del usage[keys[-1]]
    else:
        usage["prompt_tokens_details"][keys[-1]] = None
    return json.dumps({"usage": usage})


def test_usage_is_parsed(spark):
    bodies = [
        GOOD, "  \n" + GOOD, f"data: {{}}\n\n{CHUNK}\n\ndata: [DONE]\n", CHUNK + "\r\n\r\ndata: \r\n", f": ping\n{CHUNK}",
        f"{CHUNK} data: not a line start",
    ]
    for row in parsed(spark, bodies[:5]):
        assert tuple(row.usage) == (50, 7, 30, 20) and row.usage_reason is None


@pytest.mark.parametrize(
    "body,reason",
    [
        ("", "empty body"), (None, "empty body"), ("{}", "usage missing"), ('{"usage": null}', "usage missing"),
        ("not json", "usage missing"), ("{broken", "usage missing"), (f"{CHUNK}\ndata: {{}}\n", "usage missing"),
        (without("prompt_tokens_details"), "usage incomplete"), (without("cached_tokens"), "usage incomplete"),
        (without("completion_tokens"), "usage incomplete"), (without("prompt_tokens"), "usage incomplete"),
        (" " + CHUNK, "usage missing"), ("data:{}", "usage missing"),
    ],
)
def test_unusable_usage_has_a_reason(spark, body, reason):
    row = parsed(spark, [body])[0]
    assert row.usage is None and row.usage_reason == reason


def test_mtok_cost(spark):
    row = with_usage(spark.createDataFrame([(GOOD,)], "body STRING")).select(cost.mtok_cost(F.col("usage")).alias("m")).first()
    assert row.m == Decimal("0.000087")


PRICE = [("m", "t", 2.0, 10.0, 0.2, 2.5, None)]
BLANK = [("m", "t", 2.0, 10.0, 0.2, None, None)]
COLUMNS = "model STRING, tag STRING, base_input_per_mtok DOUBLE, output_per_mtok DOUBLE, cache_hit_refresh_per_mtok DOUBLE, `5m_cache_write_per_mtok` DOUBLE, `1h_cache_write_per_mtok` DOUBLE"


def priced(spark, prices, model="m", written=20, strict=True):
    body = json.loads(GOOD)
    body["usage"]["prompt_tokens_details"]["cache_write_tokens"] = written
    calls = with_usage(spark.createDataFrame([(json.dumps(body), model)], "body STRING, model STRING"))
    return cost.with_usd_cost(calls, spark.createDataFrame(prices, COLUMNS), strict=strict).first()


def test_usd_cost(spark):
    assert priced(spark, PRICE).usd == pytest.approx(0.000226)


def test_missing_rate_matters_only_with_tokens(spark):
    assert priced(spark, BLANK, written=0).usd == pytest.approx((140 + 70 + 6) / 1e6)
    with pytest.raises(Exception, match="cache_creation_input_tokens without"):
        priced(spark, BLANK)
    row = priced(spark, BLANK, strict=False)
    assert row.usd is None and "cache_creation" in row.usd_error


def test_unknown_model(spark):
    with pytest.raises(Exception, match="no rates for model other"):
        priced(spark, PRICE, model="other")
    assert priced(spark, PRICE, model="other", strict=False).usd_error == "no rates for model other"


def test_price_tables_must_not_overlap(spark):
    table = spark.createDataFrame(PRICE, COLUMNS)
    with pytest.raises(ValueError, match="more than one table"):
        cost.merge_prices(table, table)
    assert cost.rates_long(spark.createDataFrame(BLANK, COLUMNS)).count() == 3


def test_weights_must_name_known_counters(spark):
    good = spark.createDataFrame([("input_tokens", 1.0, "")], "counter STRING, weight DOUBLE, description STRING")
    assert cost.weights_of(good) == {"input_tokens": Decimal("1.0")}
    with pytest.raises(ValueError):
        cost.weights_of(good.union(good))


def test_routes(spark):
    calls = spark.createDataFrame([("a",)], "model STRING")
    routes = spark.createDataFrame([("a", "s", "p")], "model STRING, slug STRING, provider STRING")
    assert routing.resolve_routes(calls, routes).first().slug == "s"
    with pytest.raises(Exception, match="no route for model b"):
        routing.resolve_routes(spark.createDataFrame([("b",)], "model STRING"), routes).collect()


def test_annotated_bodies(spark):
    bodies = [GOOD, f"data: {{\"a\": 1}}\n\n{CHUNK}\n\ndata: [DONE]\n", GOOD + "\n"]
    rows = with_usage(spark.createDataFrame(list(enumerate(bodies)), "i INT, body STRING"))
    billed = billed_usage(F.col("usage"), cost.mtok_cost(F.col("usage")))
    got = [r.x for r in rows.select("i", annotate_body(F.col("body"), billed).alias("x")).orderBy("i").collect()]
    expected = {
        "input_mtok": 50 / 1e6, "output_mtok": 7 / 1e6, "cache_read_input_mtok": 30 / 1e6, "cache_creation_input_mtok": 20 / 1e6,
        "total_cost_mtok": 0.000087,
    }
    for text in (got[0], got[2]):
        assert json.loads(text) == {**json.loads(GOOD), "harness_billed_usage": expected}
    lines = got[1].split("\n")
    assert lines[0] == 'data: {"a": 1}' and lines[4] == "data: [DONE]" and len(lines) == 6
    assert json.loads(lines[2][6:])["harness_billed_usage"] == expected
