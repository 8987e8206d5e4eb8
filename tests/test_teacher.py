import pytest
from pyspark.sql import functions as F

from gradeline import schemas
from gradeline.operators import report, teacher
from gradeline.plans import training


def records(spark, cases):
    """(system, user, reply) per record; None leaves the turn out, reply None is an empty reply."""
    rows = []
    for i, (system, user, reply) in enumerate(cases):
        turns = [(r, c) for r, c in (("system", system), ("user", user)) if c is not None]
        rows.append((i, (turns, "m", 1, None, None), (0.0, 0.0), 0.0, ([(("assistant", reply), "stop")], None, None)))
    return spark.createDataFrame(rows, schemas.RAW_CALL)


def test_teacher_rows(spark):
    rows = teacher.teacher_rows(records(spark, [("s", "u", "E"), ("s", "u", None), (None, "u", "E"), ("s", None, "E")]))
    got = {r.idx: r.skipped for r in rows.collect()}
    assert got == {0: None, 1: "no reply", 2: "no system turn", 3: "no user turn"}
    assert tuple(teacher.teacher_counts(rows).first()) == (1, 3)
    assert [r.idx for r in teacher.kept_rows(rows).collect()] == [0]
    empty = records(spark, [("s", "u", "E")]).withColumn("response", F.lit(None).cast(schemas.RESPONSE))
    assert teacher.teacher_rows(empty).first().skipped == "no reply"


def test_length_limit_is_inclusive(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "idx INT, t STRING")
    assert [r.idx for r in teacher.within_length(df, F.col("t"), 3).collect()] == [1]


def test_window_fit(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "idx INT, t STRING")
    got = {r.idx: (r.fits, r.error) for r in teacher.window_fit(df, F.col("t"), 7, 10).collect()}
    assert got == {1: (True, None), 2: (False, "prompt of 4 tokens plus max_tokens 7 exceeds max_model_len 10")}


def test_supplied_tokenizer(spark):
    count = teacher.token_counter(lambda: lambda texts: [len(t) for t in texts])
    df = spark.createDataFrame([(1, "abc"), (2, None)], "i INT, t STRING")
    assert [r.n for r in df.select("i", count(F.col("t")).alias("n")).orderBy("i").collect()] == [3, None]


def test_label_rows_calls_in_chunks_and_skips_nulls(spark):
    def make():
        def predict(prompts):
            assert len(prompts) <= 4
            return [p.upper() for p in prompts]

        return predict

    df = spark.range(30).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("p"), "id")).alias("p")).repartition(3)
    got = {r.id: r.pred for r in teacher.label_rows(df, "p", make, chunk=4).collect()}
    assert got == {i: f"P{i}" if i % 5 else None for i in range(30)}


def test_best_point_takes_the_first_of_equals(spark):
    sweep = spark.createDataFrame([(0, 1e-4, 0.5, "a", 1.0), (2, 1e-6, 0.25, "c", 1.0), (1, 1e-5, 0.25, "b", 1.0)], schemas.SWEEP)
    assert teacher.best_point(sweep.repartition(3)).first().student_dir == "b"
    row = training.selection(sweep).select(
        F.get_json_object("metrics", "$.selected.student_dir").alias("s"), F.get_json_object("metrics", "$.sweep[0].student_dir").alias("f")
    ).first()
    assert (row.s, row.f) == ("b", "a")


def test_training_sets(spark):
    rows = training.training_sets(records(spark, [("s", f"u{i}", "E") for i in range(25)] + [("s", "u", None)]), 0.1, 3)
    parts = [r.part for r in rows.collect()]
    assert (parts.count("eval"), parts.count("train")) == (2, 23)
    row = rows.first()
    assert [t.role for t in row.prompt] == ["system", "user"] and row.completion[0].content == "E"
    assert row.chat_template_kwargs.enable_thinking is False
    short = training.training_sets(records(spark, [("s", "u " * (i + 1), "E") for i in range(10)]), 0.1, 3, max_length=6)
    assert short.where("part = 'eval'").count() == 1 and short.where("part = 'train'").count() <= 4


def test_gain_and_primary_metric(spark):
    runs = spark.createDataFrame(
        [("extraction", '{"f1": 0.55}'), ("detection", '{"score_agg": {"all": {"auroc": 0.75}}}'), ("relevance", "{}"), ("other", "{}")],
        "task STRING, metrics STRING",
    )
    scored = report.primary_metric(runs)
    assert {r.task: r.metric for r in scored.collect()} == {"extraction": 0.55, "detection": 0.75, "relevance": None, "other": None}
    limits = spark.createDataFrame([("extraction", 0.1, 1.0), ("detection", 0.5, 0.5)], "task STRING, trivial DOUBLE, perfect DOUBLE")
    gains = {r.task: r.gain for r in report.normalized_gain(scored, limits).collect()}
    assert gains["extraction"] == pytest.approx(0.5) and gains["detection"] is None and gains["other"] is None


def test_model_calls_have_the_chunk_size(spark):
    def load():
        def predict(texts):
            return [str(len(texts))] * len(texts)

        return predict

    df = spark.range(25, numPartitions=1).select("id", F.struct("id").alias("s"), F.when(F.col("id") != 3, "p").alias("prompt"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = teacher.label_rows(df, "prompt", load, chunk=10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.pred for r in got] == ["9"] * 3 + [None] + ["9"] * 6 + ["10"] * 10 + ["5"] * 5
    assert [r.s.id for r in got] == list(range(25))


def test_long_prompts_are_not_all_held_at_once(spark, monkeypatch):
    def load():
        return lambda texts: [str(len(texts))] * len(texts)

    monkeypatch.setattr(teacher, "CALL_CHARS", 40)
    prompt = F.when(F.col("id") == 2, F.repeat(F.lit("x"), F.lit(100))).when(F.col("id") != 5, F.lit("0123456789"))
    df = spark.range(12, numPartitions=1).select("id", prompt.alias("prompt"))
    got = teacher.label_rows(df, "prompt", load, chunk=10).collect()
    assert [r.pred for r in got] == ["3"] * 3 + ["4"] * 2 + [None] + ["4"] * 2 + ["4"] * 4
    assert [r.id for r in got] == list(range(12))


def test_a_call_holds_a_few_million_code_points(spark):
    def load():
        return lambda texts: [str(sum(map(len, texts)))] * len(texts)

    df = spark.range(250, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(50_000)).alias("prompt"))
    got = [int(r.pred) for r in teacher.label_rows(df, "prompt", load).select("pred").collect()]
    assert len(got) == 250 and max(got) < (1 << 22) + 50_000


def test_a_model_sees_the_prompts_alone(spark):
    """Other columns stay out of the Python workers, and a condition on the reply asks nothing again."""
    asked = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            asked.add(len(texts))
            return [t[::-1] for t in texts]

        return predict

    df = spark.range(40).select("id", F.repeat(F.lit("w"), F.lit(9)).alias("wide"), F.format_string("p%s", "id").alias("prompt"))
    rows = teacher.label_rows(df, "prompt", load)
    assert rows.columns == ["id", "wide", "prompt", "pred"]
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.pred for r in rows.where("pred >= '3' AND length(pred) = 3").collect()} == {i: f"p{i}"[::-1] for i in range(10, 40) if f"{i}"[1] >= "3"}
    assert asked.value == 40


def test_each_prompt_is_asked_once_when_predictions_are_written(spark, tmp_path):
    from gradeline.sources.writers import write_predictions

    asked = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            asked.add(len(texts))
            return ["a"] * len(texts)

        return predict

    df = spark.range(100).select(F.col("id").alias("idx"), F.lit("p").alias("prompt"))
    records = teacher.label_rows(df, "prompt", load).withColumn("response", F.col("pred"))
    write_predictions(records, f"{tmp_path}/out", f"{tmp_path}/raw")
    assert asked.value == 100
