import random

import pytest
from pyspark.sql import functions as F

from gradeline.functions import replies
from gradeline.operators import scoring


def test_relevance_letter(spark):
    cases = {"e": "E", " S\n": "S", "Exact": "", "": "", " i\x1f": "I", "E S": "", "ſ": "S"}
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([*cases, None])], "i INT, v STRING")
    got = [r.x for r in rows.select("i", replies.relevance_letter(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [*cases.values(), ""]


def confidence(text):
    try:
        value = float((text or "").strip())
    except ValueError:
        return 0.5
    return value if 0.0 <= value <= 1.0 else 0.5


def test_detection_score_like_python(spark):
    cases = [
        "0.5", "1", "-0", "1.0001", "-0.1", "abc", "", None, "nan", "inf", "-inf", "Infinity", ".5", "1e-1", "0.5f",
        "0.9f", "0.9d", "0_0.2_5", "_1", "1_", "1__0", " 0.75 ", " 0.25\x1f", "Machine: 0.9", "+.1", "1.", "1.e0",
        "0x1", "1e", "1e5", "0.3e+0", "0.3e-0_1", "٠", ".", "+", "1e-400", "0.1\n0.2",
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "i INT, v STRING")
    got = [r.x for r in rows.select("i", replies.detection_score(F.col("v")).alias("x")).orderBy("i").collect()]
    expected = [confidence(c) for c in cases]
    expected[cases.index("٠")] = 0.5  # digits of other scripts are not taken
    assert got == expected
    assert str(got[2]) == "0.0"


OUTCOMES = [
    ([], "", "n_n"), ([], "red", "n_a"), (["Red"], "<NO_VALUE>", "a_n"), (["Red", "Crimson"], "the crimson.", "a_a"),
    (["Red"], "blue", "a_b"), (["the"], "", "n_n"), (["Red"], "the", "a_n"), (["Red"], '{"error": 1}', "a_b"),
]


def extraction(spark, cases):
    gold = spark.createDataFrame(
        [(i, [{"value": v} for v in g]) for i, (g, _, _) in enumerate(cases)], "idx BIGINT, evidences ARRAY<STRUCT<value: STRING>>"
    )
    preds = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(cases)], "idx BIGINT, pred STRING")
    return gold, preds


def test_extraction_outcomes(spark):
    gold, preds = extraction(spark, OUTCOMES)
    staged = preds.withColumn("pred", replies.extraction_value(F.col("pred")))
    got = scoring.extraction_outcomes(gold.join(staged, "idx")).orderBy("idx").collect()
    assert [r.outcome for r in got] == [o for _, _, o in OUTCOMES]


def test_extraction_metrics(spark):
    cases = [(["x"], "x", "")] * 3 + [(["x"], "y", "")] + [(["x"], "", "")] * 2 + [([], "y", "")] + [([], "", "")] * 5
    row = scoring.score_extraction(*extraction(spark, cases)).first()
    assert (row.precision, row.recall, round(row.f1, 6), row.n_scored) == (0.6, 0.5, 0.545455, 12)
    empty = scoring.score_extraction(*extraction(spark, [([], "", "")])).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_extraction_wants_equal_counts(spark):
    gold, preds = extraction(spark, OUTCOMES)
    with pytest.raises(Exception, match="7 predictions for 8 rows"):
        scoring.score_extraction(gold, preds.where("idx > 0")).collect()


def test_f1_fixture(spark):
    pairs = spark.createDataFrame(
        [("E", "E"), ("E", "S"), ("S", "S"), ("C", "I")], "label STRING, predicted STRING"
    )
    row = scoring.f1_scores(scoring.confusion(pairs)).first()
    assert (row.micro_f1, round(row.macro_f1, 6), row.n_scored) == (0.5, 0.333333, 4)


def brute_macro(pairs):
    names = {t for t, _ in pairs} | {p for _, p in pairs}
    scores = []
    for n in names:
        tp = sum(t == p == n for t, p in pairs)
        total = sum(t == n for t, _ in pairs) + sum(p == n for _, p in pairs)
        scores.append(2 * tp / total)
    return sum(scores) / len(scores)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_f1_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice("ESC"), rng.choice("ESCI")) for _ in range(rng.randint(1, 60))]
    rows = spark.createDataFrame(pairs, "label STRING, predicted STRING").repartition(5)
    row = scoring.f1_scores(scoring.confusion(rows)).first()
    assert row.macro_f1 == pytest.approx(brute_macro(pairs))
    assert row.micro_f1 == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))


def test_relevance_fills_missing_and_refuses_extra(spark):
    gold = spark.createDataFrame([(i, f"x{i}", "Exact") for i in range(6)], "idx BIGINT, example_id STRING, label STRING")
    preds = spark.createDataFrame([(0, "e"), (1, "junk")], "idx BIGINT, pred STRING")
    used = {r.idx: r.predicted for r in scoring.relevance_predictions(gold, preds).collect()}
    assert used[0] == "Exact" and set(used.values()) <= set(replies.RELEVANCE_LABELS.values()) and len(used) == 6
    assert scoring.score_relevance(gold, preds).first().n_scored == 6
    extra = preds.union(spark.createDataFrame([(i, "e") for i in range(6, 12)], preds.schema))
    with pytest.raises(Exception, match="predictions"):
        scoring.score_relevance(gold, extra).collect()
    stray = spark.createDataFrame([(9, "e")], preds.schema)
    with pytest.raises(Exception, match="without a gold row"):
        scoring.score_relevance(gold, stray).collect()
