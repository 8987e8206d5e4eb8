import json
import random

import pytest
from pyspark.sql import functions as F

from gradeline import schemas
from gradeline.plans import workload
from gradeline.sources import readers, writers


def test_csv_quotes_line_breaks_and_empty_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'id,extra,text\n1,e,"two\nlines, ""quoted"""\n2,,\n3,e, padded \n')
    rows = readers.read_quoted_csv(spark, str(tmp_path), ["text", "id"]).orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", ""), ("3", " padded ")]


def test_csv_long_field(spark, tmp_path):
    long = "x" * 2_000_000
    (tmp_path / "x.csv").write_text(f'id,text\n1,"{long}"\n')
    assert readers.read_quoted_csv(spark, str(tmp_path), ["id", "text"]).select(F.length("text")).first()[0] == 2_000_000


def test_prediction_lines_take_any_line_end(spark, tmp_path):
    (tmp_path / "out.txt").write_bytes(b"a\rb\r\nc\nd\n\ne")
    rows = readers.read_predictions(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.pred) for r in rows] == list(enumerate(["a", "b", "c", "d", "", "e"]))


def test_json_lines_cut_at_newline_only(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"a": 1}\r\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_json_lines(spark, str(tmp_path), "a INT").collect()) == [1, 2]


@pytest.mark.parametrize("split_bytes", ["97", "1000", "134217728"])
def test_line_numbers_and_offsets_over_splits(spark, tmp_path, split_bytes):
    rng = random.Random(int(split_bytes))
    expected, line = [], 0
    for name in ("a.txt", "b.txt"):
        offset, lines = 0, ["é" * rng.randint(0, 30) + str(i) for i in range(200)]
        (tmp_path / name).write_bytes(("\n".join(lines) + "\n").encode())
        for text in lines:
            expected.append((line, offset, text))
            line, offset = line + 1, offset + len(text.encode()) + 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        raw = readers.read_raw_lines(spark, str(tmp_path))
        if split_bytes == "97":
            assert raw.rdd.getNumPartitions() > 20
        numbered = {r.line: r.value for r in readers.with_line_numbers(raw).collect()}
        offsets = {r.line: r.offset for r in readers.line_offsets(raw).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert numbered == {n: t for n, _, t in expected}
    assert offsets == {n: o for n, o, _ in expected}


def test_changed_splits_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(str(i) for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        numbered = readers.with_line_numbers(readers.read_raw_lines(spark, str(tmp_path)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        with pytest.raises(Exception, match="cut differently"):
            numbered.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shards_have_split_and_order(spark, tmp_path):
    one = spark.createDataFrame([(7, "first"), (8, "first")], "example_id BIGINT, query STRING")
    blank = [F.lit(None).cast("string").alias(c) for c in ("product_id", "product_title", "product_brand", "product_color", "product_description", "product_bullet_point", "product_locale", "esci_label")]
    full = [*blank, F.lit(1).cast("bigint").alias("query_id"), F.lit(0).alias("large_version"), F.lit("no").alias("unread")]
    for split, rows in (("train", one), ("test", one.where("example_id = 7").withColumn("query", F.lit("second")))):
        rows.select("example_id", "query", *full).coalesce(1).write.mode("append").option("mapreduce.output.basename", split).parquet(str(tmp_path / "s"))
    shards = readers.read_shards(spark, str(tmp_path / "s"))
    assert "unread" not in shards.columns and {r.split for r in shards.collect()} == {"train", "test"}
    built = {r.example_id: (r.query, r.split) for r in workload.build_relevance(spark, str(tmp_path / "s")).collect()}
    assert built == {"7": ("second", "test"), "8": ("first", "train")}


def test_whole_workload_path(spark, tmp_path):
    full = [{"attributes": [{"key": f"k{i}", "evidences": [{"value": str(i)}]}], "paragraphs": [{"text": f"t{i}"}], "id": str(i), "category": "c"} for i in range(50)]
    (tmp_path / "full.jsonl").write_text("\n".join(map(json.dumps, full)) + "\n")
    paths = workload.sample_full(
        spark, str(tmp_path / "full.jsonl"), schemas.EXTRACTION_FULL, str(tmp_path / "views"), ["attribute", "paragraphs"], 5, 12,
        single_attribute=True,
    )
    assert set(paths) == {"questions", "gt", "offsets"} and paths["gt"].endswith("n12_seed5_gt")
    questions, gold = workload.load_sample(
        spark, str(tmp_path / "views"), "n12_seed5", "attribute STRING, paragraphs ARRAY<STRUCT<text: STRING>>",
        "id STRING, category STRING, evidences ARRAY<STRUCT<value: STRING>>",
    )
    offsets = {r.idx: r for r in writers.read_view(spark, paths["offsets"], "idx BIGINT, line BIGINT, offset BIGINT").collect()}
    raw = (tmp_path / "full.jsonl").read_bytes()
    rows = questions.join(gold, "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(12))
    for r in rows:
        item = json.loads(raw[offsets[r.idx].offset :].split(b"\n", 1)[0])
        assert item["id"] == r.id == str(offsets[r.idx].line) and item["attributes"][0]["key"] == r.attribute
        assert r.evidences[0].value == r.id
    assert workload.load_sample(spark, str(tmp_path / "views"), "n12_seed5", "attribute STRING")[1] is None
    with pytest.raises(ValueError, match="asked for 51 rows"):
        workload.sample_full(spark, str(tmp_path / "full.jsonl"), schemas.EXTRACTION_FULL, str(tmp_path / "more"), ["paragraphs"], 5, 51)


def test_predictions_round_trip(spark, tmp_path):
    preds = ["a", "two\nlines", "", "cr\rhere", 'q"']
    df = spark.createDataFrame(list(enumerate(preds)), "idx BIGINT, pred STRING").repartition(3)
    writers.write_predictions(df.withColumn("cost", F.struct(F.lit(0.5).alias("mtok"))), str(tmp_path / "o"), str(tmp_path / "r"), raw_every=2)
    back = [r.pred for r in readers.read_predictions(spark, str(tmp_path / "o")).orderBy("idx").collect()]
    assert back == ["a", '"two\\nlines"', "", '"cr\\rhere"', 'q"']
    assert sorted(r.idx for r in spark.read.json(str(tmp_path / "r")).collect()) == [0, 2, 4]


def test_prices_weights_routes(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "model,tag,base_input_per_mtok,output_per_mtok,cache_hit_refresh_per_mtok,5m_cache_write_per_mtok,1h_cache_write_per_mtok\nm,t,0.09,0.18,0.018,,\n"
    )
    row = readers.read_prices(spark, str(tmp_path / "p.csv")).first()
    assert row["output_per_mtok"] == 0.18 and row["5m_cache_write_per_mtok"] is None
    (tmp_path / "r.csv").write_text("model,slug,provider\nm,s,p\n")
    assert readers.read_routes(spark, str(tmp_path / "r.csv")).first().slug == "s"


def test_documents_and_tags(spark, tmp_path):
    writers.write_document(spark.sql("SELECT 0.5 AS f1, 3L AS n, CAST(NULL AS STRING) AS note"), str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"f1": 0.5, "n": 3}
    assert writers.sample_tag(7) == "full_seed7" and writers.sample_tag(7, 10) == "n10_seed7"


def test_the_sample_does_not_hang_on_the_files(spark, tmp_path):
    from gradeline.sources.writers import read_view

    rows = [(f"r{i}", f"text {i}") for i in range(200)]
    got = []
    for layout, order in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "id STRING, text STRING").repartition(layout)
        df.write.json(f"{tmp_path}/full{layout}")
        paths = workload.sample_full(
            spark, f"{tmp_path}/full{layout}", "id STRING, text STRING", f"{tmp_path}/out{layout}", ["text"], 3, 50, key="id"
        )
        got.append([(r.idx, r.text) for r in read_view(spark, paths["questions"], "idx BIGINT, text STRING").orderBy("idx").collect()])
    assert got[0] == got[1] and len(got[0]) == 50


def test_part_numbers_order_lines(spark, tmp_path):
    for number in (99999, 100000, 7):
        (tmp_path / f"part-{number:05d}-x.txt").write_text(f"{number}\n")
    lines = readers.with_line_numbers(readers.read_raw_lines(spark, str(tmp_path)))
    assert [r.value for r in lines.orderBy("line").collect()] == ["7", "99999", "100000"]


def test_line_numbers_over_folders_and_many_files(spark, tmp_path):
    """Sums by file, folder and folders: numbers and offsets as of the files read one after another."""
    expected, line = {}, 0
    for folder in ("a", "b", "c"):
        (tmp_path / folder).mkdir()
        for n in range(40):
            texts = [f"{folder}{n}-{i}" + "é" * (n % 3) for i in range(n % 4)]
            (tmp_path / folder / f"part-{n + 99_980}.txt").write_text("".join(t + "\n" for t in texts))
            at = 0
            for t in texts:
                expected[line] = (t, at)
                line, at = line + 1, at + len(t.encode()) + 1
    lines = readers.read_raw_lines(spark, str(tmp_path / "*"))
    starts = readers.split_starts(lines)
    offsets = readers.line_offsets(lines, starts)
    rows = readers.with_line_numbers(lines, starts).join(offsets, "line").collect()
    assert {r.line: (r.value, r.offset) for r in rows} == expected and len(rows) == line
