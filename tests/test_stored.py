import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradeline.operators import sampling
from gradeline.operators.detection import score_rows
from gradeline.plans.tasks import score
from gradeline.sources import stored, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tag():
    return f"t{uuid.uuid4().hex}"


def test_stored_views_meet_without_exchange(spark, tmp_path, no_broadcast):
    rows = spark.range(400).withColumnRenamed("id", "idx")
    gold = rows.select(
        "idx", F.col("idx").cast("string").alias("example_id"), F.lit("Exact").alias("label"),
        F.array(F.struct(F.lit("a").alias("value"))).alias("evidences"),
    )
    preds = rows.where("idx < 390").select("idx", F.when(F.col("idx") % 2 == 0, "E").otherwise("S").alias("pred"))
    found = stored.store_views({"gt": gold, "pred": preds}, tag(), str(tmp_path), buckets=4)
    gt, pred = found["gt"], found["pred"]
    for joined in (score(gt, pred, "relevance"), score_rows(gt, pred), sampling.merge_views(gt, pred), score(gt, pred, "extraction")):
        shown = plan(joined)
        assert "hashpartitioning(idx" not in shown and "SelectedBucketsCount: 4 out of 4" in shown, shown
    assert "hashpartitioning(idx" in plan(score(gold, preds, "relevance"))
    assert score(gt, pred, "relevance").first() == score(gold, preds, "relevance").first()
    assert len(list((tmp_path).glob("*_gt/*.parquet"))) == 4


def test_stored_view_in_another_catalog(spark, tmp_path, no_broadcast):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (1, "b")], "idx INT, text STRING")
    name, path = tag(), str(tmp_path / "v")
    stored.store_view(rows, name, path, 3)
    with pytest.raises(AnalysisException):
        stored.store_view(rows, name, path + "2", 3)
    spark.sql(f"DROP TABLE {name}")
    again = stored.attach_view(spark, name, path, "text STRING", 3)
    assert sorted(again.collect(), key=str) == sorted(rows.collect(), key=str)
    assert "hashpartitioning(idx" not in plan(again.groupBy("idx").agg(F.min("text")))
    empty = stored.store_view(rows.where("false"), tag(), str(tmp_path / "e"), 2)
    assert empty.count() == 0 and [stored.view_buckets(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 10**13)] == [1, 1, 1, 2, 100_000]


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "test")
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [(k, o) for k in ("a", "b", None, "c") for o in range({"a": 5, "b": 1, None: 3, "c": 2}[k])]
    df = spark.createDataFrame(rows, "k STRING, o INT").repartition(3)
    counts, taken = jobs(spark, lambda: writers.write_first_wins(df, ["k"], ["o"], str(tmp_path / "a")))
    _, plain = jobs(spark, lambda: sampling.first_wins(df, ["k"], ["o"]).write.parquet(str(tmp_path / "b")))
    assert counts == {"n_read": 11, "n_kept": 4, "n_dropped": 7} and taken <= plain
    kept = spark.read.parquet(str(tmp_path / "a"))
    assert kept.columns == ["k", "o"] and sorted(kept.collect(), key=str) == sorted([(k, 0) for k in ("a", "b", None, "c")], key=str)
    assert writers.write_first_wins(df.where("false"), ["k"], ["o"], str(tmp_path / "e")) == {"n_read": 0, "n_kept": 0, "n_dropped": 0}


def test_write_of_other_rows_than_expected_leaves_nothing(spark, tmp_path):
    path = tmp_path / "x"
    with pytest.raises(ValueError, match="expected 6 rows, found 5"):
        writers.write_counted(spark.range(5), str(path), expected=6)
    assert not path.exists()
    found = writers.write_counted(spark.range(5), str(path), {"most": F.max("id")}, expected=5)
    assert found == {"n_rows": 5, "most": 4} and spark.read.parquet(str(path)).count() == 5
