"""Runs that stop and go on: nothing twice, nothing lost, nothing uncommitted seen."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeline.sources.run_files import RunFiles


def records(spark, indices):
    return spark.createDataFrame([(i, f"a{i}", Decimal("0.5")) for i in indices], "idx long, pred string, mtok decimal(28,9)")


def found(run):
    return sorted((r.idx, r.pred, r.number) for r in run.numbered().collect())


def test_append_and_resume(spark, tmp_path):
    run = RunFiles(spark, str(tmp_path / "run"))
    data = spark.range(10).withColumnRenamed("id", "idx")
    assert found(run) == [] and run.spent() == 0
    assert run.state(data).first().asDict() == {"n_dataset": 10, "n_out": 0, "n_raw": 0, "n_pending": 10, "problem": None}
    entry = run.append(records(spark, [0, 1, 2, 5]))
    assert (entry["number"], entry["n_out"], entry["first_idx"], entry["last_idx"]) == (0, 4, 0, 5)
    run.write_part(records(spark, [3, 4]))
    assert len(found(run)) == 4 and sorted(r.idx for r in run.pending(data).collect()) == [3, 4, 6, 7, 8, 9]
    run.append(records(spark, range(10)))
    assert found(run) == [(i, f"a{i}", 0 if i in (0, 1, 2, 5) else 1) for i in range(10)]
    assert run.append(records(spark, range(10)))["n_out"] == 0  # nothing is left to do
    again = RunFiles(spark, str(tmp_path / "run"))
    assert again.spent() == Decimal("5") and len(again.entries()) == 3
    assert again.state(data).first().problem is None


def test_a_model_is_asked_once_for_what_is_missing(spark, tmp_path):
    run, asked = RunFiles(spark, str(tmp_path / "run")), spark.sparkContext.accumulator(0)
    run.append(records(spark, range(6)))

    @F.udf("string")
    def model(idx):
        asked.add(1)
        return f"m{idx}"

    rows = spark.range(20).withColumnRenamed("id", "idx")
    run.append(rows, label=lambda left: left.withColumn("pred", model("idx")))
    assert asked.value == 14 and len(found(run)) == 20


def test_two_appends_at_once(spark, tmp_path):
    one, other = (RunFiles(spark, str(tmp_path / "run")) for _ in range(2))
    entry = {"number": 0, **one.write_part(records(spark, [1]))}
    other.append(records(spark, [2]))
    with pytest.raises(Exception, match="AlreadyExists"):
        one._commit(entry)
    assert found(one) == [(2, "a2", 0)]


def test_repeated_index_is_reported(spark, tmp_path):
    run = RunFiles(spark, str(tmp_path / "run"))
    run.append(records(spark, [1, 1, 2]))
    assert run.state(spark.range(5).withColumnRenamed("id", "idx")).first().problem == "an index has several predictions"


def test_rows_are_not_moved_to_meet_a_run_without_predictions(spark, tmp_path):
    run = RunFiles(spark, f"{tmp_path}/run")
    assert run.predictions().schema.simpleString() == "struct<idx:bigint,pred:string>" and run.predictions().isEmpty()
    rows = spark.range(50).select(F.lit("p").alias("pred"), F.col("id").alias("idx"))
    left = run.pending(rows)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert left.columns == ["idx", "pred"] and sorted(r.idx for r in left.collect()) == list(range(50))


def test_a_runs_sample_is_put_in_order_once(spark, tmp_path):
    from catalog import logs

    docs = [(i, f"t{i}", "src0", 10 * i) for i in range(30)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    records = logs._records(spark, str(tmp_path))
    assert "Window" not in records._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.idx for r in records.collect()) == list(range(30))
