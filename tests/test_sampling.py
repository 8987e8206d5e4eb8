import hashlib

import pytest
from pyspark.sql import functions as F

from gradeline.operators import sampling, shaping


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def shuffled(seed, keys):
    return sorted(keys, key=lambda k: (digest(seed, k), k))


@pytest.mark.parametrize("partitions", [1, 9])
def test_seeded_order(spark, partitions):
    df = spark.range(500).withColumnRenamed("id", "key").repartition(partitions)
    rows = {r.idx: r.key for r in sampling.seeded_order(df, "key", 4).collect()}
    expected = shuffled(4, range(500))
    assert [rows[i] for i in range(500)] == expected
    first = {r.idx: r.key for r in sampling.seeded_order(df, "key", 4, num=37).collect()}
    assert first == dict(enumerate(expected[:37]))
    assert sampling.seeded_order(df, "key", 4, num=900).count() == 500
    assert sampling.seeded_order(df, "key", 4, num=0).count() == 0


@pytest.mark.parametrize("n,fraction", [(25, 0.1), (9, 0.1), (300, 0.25), (7, 1.0)])
def test_holdout_split(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "key").repartition(3)
    held = {r.key for r in sampling.holdout_split(df, "key", fraction, 0).where("part = 'eval'").collect()}
    assert held == set(shuffled(0, range(n))[: int(n * fraction)])


def test_first_wins(spark):
    rows = [(7, "a", 0, "x"), (8, "a", 1, "y"), (7, "b", 0, "z"), (8, "a", 0, None)]
    df = spark.createDataFrame(rows, "example_id INT, file STRING, row INT, v STRING").repartition(4)
    kept = {r.example_id: r.v for r in sampling.first_wins(df, ["example_id"], ["file", "row"]).collect()}
    assert kept == {7: "x", 8: None}
    counts = sampling.duplicate_counts(df, ["example_id"]).first()
    assert tuple(counts) == (4, 2, 2)


def test_first_wins_keeps_null_keys_and_moves_a_key_once(spark):
    rows = [(None, 3, "x"), (None, None, "y"), ("a", 2, "z"), ("a", 1, "w")]
    df = spark.createDataFrame(rows, "k STRING, place INT, v STRING")
    kept = sampling.first_wins(df, ["k"], ["place"])
    assert sorted(r.v for r in kept.collect()) == ["w", "y"] and kept.columns == df.columns
    assert "named_struct(k" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_first_wins_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), (3000 - F.col("id")).alias("row"))
    kept = {r.k: r.row for r in sampling.first_wins(df, ["k"], ["row"]).collect()}
    assert len(kept) == 1000 and kept[0] == 1


def test_views(spark):
    sample = spark.createDataFrame([(0, "q0", "E"), (1, None, "S")], "idx BIGINT, query STRING, label STRING")
    questions, gold = sampling.views(sample, ["query"])
    assert questions.columns == ["idx", "query"] and gold.columns == ["idx", "label"]
    merged = sampling.merge_views(questions.withColumn("label", F.lit("?")), gold).orderBy("idx").collect()
    assert [(r["query"], r.label) for r in merged] == [("q0", "E"), (None, "S")]
    assert sampling.views(sample, ["query"], ["label"])[1].columns == ["idx", "label"]


def test_one_attribute_only(spark):
    schema = "id INT, attributes ARRAY<STRUCT<key: STRING, evidences: ARRAY<STRUCT<value: STRING>>>>"
    good = spark.createDataFrame([(1, [("color", [("red",)])])], schema)
    row = sampling.lift_single_attribute(good).first()
    assert (row.attribute, row.evidences[0].value) == ("color", "red")
    bad = spark.createDataFrame([(1, [("a", []), ("b", [])])], schema)
    with pytest.raises(Exception, match="exactly one attribute"):
        sampling.lift_single_attribute(bad).collect()


def test_metadata_join_leaves_empty_paragraphs_out(spark):
    labels = spark.createDataFrame([("p1", "x"), ("p1", "y"), ("p2", "z")], "id STRING, label STRING")
    meta = spark.createDataFrame([("p1", "title", None), ("p3", "t", "d")], "id STRING, title STRING, description STRING")
    rows = shaping.join_metadata(labels, meta, "id", ["title", "description"]).collect()
    assert sorted(r.label for r in rows) == ["x", "y"]
    assert all([(p.text, p.source) for p in r.paragraphs] == [("title", "title")] for r in rows)


def test_union_parts_numbers_the_parts(spark):
    a, b = spark.createDataFrame([(1, "x")], "i INT, v STRING"), spark.createDataFrame([("y", 2)], "v STRING, i INT")
    assert sorted((r.part_no, r.i, r.v) for r in shaping.union_parts(a, b).collect()) == [(0, 1, "x"), (1, 2, "y")]
