"""Workload-building queries: samples, views, splits, duplicates, file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.base import table
from catalog.scores import strip_sql
from gradeline.functions.text import one_line
from gradeline.operators import sampling, shaping
from gradeline.plans import workload
from gradeline.session import fresh_path
from gradeline.sources import readers, stored, writers

SEED = 7


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- seeded order ---------------------------------------------------------------------------

_ORDER = f"row_number() OVER (ORDER BY md5(concat('{SEED}:', doc_id)), doc_id)"
_SHUFFLED = f"WITH s AS (SELECT {_ORDER} - 1 AS idx, * FROM documents)"


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.seeded_order(_docs(spark, sf_dir), "doc_id", SEED, num=150)
    return sample.select("idx", "doc_id", F.md5("text").alias("text_md5"))


SEEDED_SAMPLE = f"{_SHUFFLED} SELECT idx, doc_id, md5(text) AS text_md5 FROM s WHERE idx < 150"


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_order(_docs(spark, sf_dir), "doc_id", SEED).select("idx", "doc_id", "lang")


SEEDED_SHUFFLE = f"{_SHUFFLED} SELECT idx, doc_id, lang FROM s"


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.views(sampling.seeded_order(_docs(spark, sf_dir), "doc_id", SEED), ["text"])


def views_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)[0].select("idx", F.md5("text").alias("text_md5"))


VIEWS_QUESTION = f"{_SHUFFLED} SELECT idx, md5(text) AS text_md5 FROM s"


def views_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)[1]


VIEWS_GOLD = f"{_SHUFFLED} SELECT idx, doc_id, lang, source, n_chars FROM s"


def views_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and gold joined back; gold's language wins over the question's."""
    questions, gold = _views(spark, sf_dir)
    merged = sampling.merge_views(questions.withColumn("lang", F.lit("?")), gold)
    return merged.select("idx", "doc_id", "lang", "source", F.md5("text").alias("text_md5"))


VIEWS_MERGED = f"{_SHUFFLED} SELECT idx, doc_id, lang, source, md5(text) AS text_md5 FROM s"


def keep_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    sampled = table(spark, sf_dir, "labels")
    return sampling.keep_sampled(docs, sampled, "doc_id").select("doc_id", "lang", "n_chars")


KEEP_SAMPLED = "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.holdout_split(_docs(spark, sf_dir), "doc_id", 0.1, SEED).select("doc_id", "part")


HOLDOUT_SPLIT = f"""
SELECT doc_id, CASE WHEN {_ORDER} <= floor((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 'eval' ELSE 'train' END AS part
FROM documents"""


# ---- duplicates, unnesting, unions ----------------------------------------------------------


def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sampling.first_wins(_docs(spark, sf_dir), ["text"], ["doc_id"])
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


FIRST_WINS_DEDUP = """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.duplicate_counts(_docs(spark, sf_dir), ["text"])


DEDUP_COUNTS = """
SELECT count(*) AS n_read, count(DISTINCT text) AS n_kept, count(*) - count(DISTINCT text) AS n_dropped FROM documents"""


def dedup_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows as files, per language, beside the counts that the write took of all rows."""
    path = fresh_path(spark, "kept")
    counts = writers.write_first_wins(_docs(spark, sf_dir), ["text"], ["doc_id"], path)
    per_lang = spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n_stored"), F.sum("doc_id").alias("doc_ids"))
    return per_lang.withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


DEDUP_WRITTEN = """
WITH kept AS (SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
SELECT lang, count(*) AS n_stored, CAST(sum(doc_id) AS BIGINT) AS doc_ids, (SELECT count(*) FROM documents) AS n_read,
  (SELECT count(*) FROM kept) AS n_kept, (SELECT count(*) FROM documents) - (SELECT count(*) FROM kept) AS n_dropped
FROM kept GROUP BY lang"""


def stored_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and gold view stored by idx and merged without moving either."""
    questions, gold = _views(spark, sf_dir)
    root = fresh_path(spark, "stored")
    found = stored.store_views({"questions": questions, "gt": gold}, f"v{uuid.uuid4().hex}", root)
    merged = sampling.merge_views(found["questions"], found["gt"])
    return merged.select("idx", "doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def attribute_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    values = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("value")))
    attribute = F.struct(F.col("p_type").alias("key"), values.alias("evidences"))
    lifted = sampling.lift_single_attribute(part.select("p_partkey", F.array(attribute).alias("attributes")))
    return lifted.select(
        "p_partkey", "attribute", F.size("evidences").cast("bigint").alias("n_evidences"),
        F.col("evidences")[0]["value"].alias("first_value"),
    )


ATTRIBUTE_UNNEST = """
SELECT p_partkey, p_type AS attribute, len(string_split(p_name, ' ')) AS n_evidences,
  split_part(p_name, ' ', 1) AS first_value FROM part"""

LANGS = ("en", "fr", "de", "es")


def _parts() -> list[F.Column]:
    """A rule per part: a language each, and one part for all others."""
    others = ~F.coalesce(F.col("lang").isin(*LANGS), F.lit(False))
    return [F.col("lang") == lang for lang in LANGS] + [others]


def union_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    merged = shaping.union_parts(*[docs.where(rule) for rule in _parts()])
    return merged.select("part_no", "doc_id", "lang")


_PART = "CAST(coalesce(list_position(['en','fr','de','es'], lang), 5) - 1 AS INTEGER)"
UNION_PARTS = f"SELECT {_PART} AS part_no, doc_id, lang FROM documents"


def labels_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source", "lang")
    joined = shaping.join_metadata(table(spark, sf_dir, "labels"), docs, "doc_id", ["text", "source"])
    return joined.select(
        "doc_id", "quality", "lang", F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
        F.md5(F.array_join("paragraphs.text", "|")).alias("text_md5"),
        F.array_join("paragraphs.source", "|").alias("sources"),
    )


LABELS_METADATA_JOIN = """
SELECT l.doc_id, quality, lang, CASE WHEN text = '' THEN 1 ELSE 2 END::BIGINT AS n_paragraphs,
  md5(CASE WHEN text = '' THEN source ELSE text || '|' || source END) AS text_md5,
  CASE WHEN text = '' THEN 'source' ELSE 'text|source' END AS sources
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


# ---- files ----------------------------------------------------------------------------------


def _write_lines(df: DataFrame, value: F.Column, path: str) -> None:
    """Text files of ``value`` whose path and line order is the order of doc_id."""
    df.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(value).write.text(path)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "lines")
    _write_lines(docs, F.concat_ws(" ", F.col("doc_id").cast("string"), one_line(F.col("text"))), path)
    preds = readers.read_predictions(spark, path)
    return preds.select("idx", F.split_part("pred", F.lit(" "), F.lit(1)).cast("bigint").alias("doc_id"), F.octet_length("pred").cast("bigint").alias("n_bytes"))


LINE_NUMBERS = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id,
  CAST(octet_length(encode(doc_id || ' ' || CASE WHEN contains(text, chr(10)) THEN to_json(text)::VARCHAR ELSE text END)) AS BIGINT) AS n_bytes
FROM documents"""


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte at which each line starts in its file; a file holds 250 consecutive ids."""
    docs, path = _docs(spark, sf_dir), fresh_path(spark, "offsets")
    value = F.concat_ws(" ", F.col("doc_id").cast("string"), one_line(F.col("text"))).alias("value")
    lines = docs.select("doc_id", F.floor(F.col("doc_id") / 250).alias("file"), value)
    lines.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    raw = readers.read_raw_lines(spark, path)
    starts = readers.split_starts(raw)
    numbered = readers.with_line_numbers(raw, starts).join(readers.line_offsets(raw, starts), "line")
    return numbered.select(F.split_part("value", F.lit(" "), F.lit(1)).cast("bigint").alias("doc_id"), "offset")


LINE_OFFSETS = f"""
SELECT doc_id, CAST(coalesce(sum(n_bytes + 1) OVER (PARTITION BY doc_id // 250 ORDER BY doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM ({LINE_NUMBERS})"""


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "csv")
    raw = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "text",
        F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("lang"), "source",
    )
    raw.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    back = readers.read_quoted_csv(spark, path, ["doc_id", "text", "lang", "source"])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.md5("text").alias("text_md5"))


CSV_ROUNDTRIP = """
SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE lang END AS lang, source, md5(text) AS text_md5 FROM documents"""


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON lines: a NULL field is left out and comes back as NULL."""
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "json")
    writers.write_full(docs.withColumn("lang", F.nullif("lang", F.lit("de"))), path)
    back = readers.read_json_lines(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


JSON_ROUNDTRIP = "SELECT doc_id, nullif(lang, 'de') AS lang, source, md5(text) AS text_md5 FROM documents"


def shape_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as train-* and test-* shards, read back, shaped; one row per customer stays."""
    orders = table(spark, sf_dir, "orders")
    path = fresh_path(spark, "shards")
    raw = orders.select(
        F.col("o_custkey").alias("example_id"), F.col("o_orderkey").alias("query_id"),
        F.col("o_orderkey").cast("string").alias("product_id"), F.col("o_orderpriority").alias("query"),
        F.when(F.col("o_totalprice") > 100000, F.lit("title")).alias("product_title"),
        *[F.lit(None).cast("string").alias(c) for c in shaping.RELEVANCE_PRODUCT[1:]],
        F.lit("us").alias("product_locale"), F.col("o_orderstatus").alias("esci_label"), F.lit(1).alias("large_version"),
    )
    for split in ("test", "train"):
        part = raw.where((F.col("esci_label") == "F") == (split == "train"))
        ordered = part.repartitionByRange("query_id").sortWithinPartitions("query_id")
        ordered.write.mode("append").option("mapreduce.output.basename", split).parquet(path)
    built = workload.build_relevance(spark, path)
    return built.select("example_id", "query_id", "query", "product_title", "label", "large_version", "split")


SHAPE_RELEVANCE = """
SELECT CAST(o_custkey AS VARCHAR) AS example_id, CAST(o_orderkey AS VARCHAR) AS query_id, o_orderpriority AS query,
  CASE WHEN o_totalprice > 100000 THEN 'title' END AS product_title, o_orderstatus AS label, 1 AS large_version,
  CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS split
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderkey) = 1"""


def shape_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    path = fresh_path(spark, "raw")
    raw = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"),
        F.when(F.col("lang") == "en", "human").otherwise(F.concat(F.lit("gen-"), "lang")).alias("model"),
        F.lit("greedy").alias("decoding"), F.lit("").alias("repetition_penalty"), F.lit("none").alias("attack"),
        F.col("lang").alias("domain"), F.col("text").alias("generation"),
    )
    raw.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    built = workload.build_detection(spark, path)
    return built.select(F.md5("text").alias("text_md5"), "id", "model", "domain", "repetition_penalty", "source_id")


SHAPE_DETECTION = """
SELECT md5(text) AS text_md5, CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'human' ELSE 'gen-' || lang END AS model,
  lang AS domain, '' AS repetition_penalty, source AS source_id FROM documents"""


def build_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("model", F.when(F.col("lang") == "en", "human").otherwise(F.col("source")))
    return shaping.machine_tally(docs)


BUILD_TALLY = """
SELECT count(*) AS n_rows, count(*) FILTER (lang = 'en') AS n_human, count(*) FILTER (lang <> 'en') AS n_machine FROM documents"""


def views_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole workload path: JSON lines, line numbers, seeded order, three views, read back by idx."""
    docs = _docs(spark, sf_dir)
    full, out = fresh_path(spark, "full"), fresh_path(spark, "views")
    _write_lines(docs, F.to_json(F.struct("doc_id", "text", "lang", "source")), full)
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING"
    workload.sample_full(spark, full, schema, out, ["text"], SEED, key="doc_id")
    tag = writers.sample_tag(SEED)
    questions, gold = workload.load_sample(spark, out, tag, "text STRING", "doc_id BIGINT, lang STRING, source STRING")
    offsets = writers.read_view(spark, f"{out}/{tag}_offsets", "idx BIGINT, line BIGINT, offset BIGINT")
    merged = sampling.merge_views(questions, gold).join(offsets, "idx")
    return merged.select("idx", "doc_id", "line", "lang", "source", F.md5("text").alias("text_md5"))


VIEWS_ROUNDTRIP = f"""{_SHUFFLED}
SELECT idx, doc_id, doc_id AS line, lang, source, md5(text) AS text_md5 FROM s"""


def extraction_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one workload in several JSON-lines files, read as one table in file order."""
    docs = _docs(spark, sf_dir)
    root = fresh_path(spark, "parts")
    paths = []
    for number, rule in enumerate(_parts()):
        paths.append(f"{root}/{number}")
        rows = docs.where(rule).select(
            F.col("doc_id").cast("string").alias("id"), F.col("source").alias("category"),
            F.array(F.struct("text", F.lit("text").alias("source"))).alias("paragraphs"),
            F.array(
                F.struct(F.lit("lang").alias("key"), F.array(F.struct(F.col("lang").alias("value"))).alias("evidences"))
            ).alias("attributes"),
        )
        writers.write_full(rows, paths[-1], order_by=[F.col("id").cast("bigint")])
    lifted = sampling.lift_single_attribute(workload.build_extraction(spark, paths))
    return lifted.select(
        "part_no", "line", "id", "category", "attribute", F.col("evidences")[0]["value"].alias("value"),
        F.md5(F.col("paragraphs")[0]["text"]).alias("text_md5"),
    )


EXTRACTION_PARTS = f"""
SELECT {_PART} AS part_no, row_number() OVER (PARTITION BY {_PART} ORDER BY doc_id) - 1 AS line, CAST(doc_id AS VARCHAR) AS id,
  source AS category, 'lang' AS attribute, lang AS value, md5(text) AS text_md5 FROM documents"""


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeline.functions.text import strip

    docs = _docs(spark, sf_dir)
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\n \x1f"))
    return docs.select("doc_id", F.md5(strip(padded)).alias("text_md5"))


STRIP_TEXT = f"SELECT doc_id, md5({strip_sql('text')}) AS text_md5 FROM documents"

QUERIES = {
    "seeded_sample": (seeded_sample, SEEDED_SAMPLE),
    "seeded_shuffle": (seeded_shuffle, SEEDED_SHUFFLE),
    "views_question": (views_question, VIEWS_QUESTION),
    "views_gold": (views_gold, VIEWS_GOLD),
    "views_merged": (views_merged, VIEWS_MERGED),
    "keep_sampled": (keep_sampled, KEEP_SAMPLED),
    "holdout_split": (holdout_split, HOLDOUT_SPLIT),
    "first_wins_dedup": (first_wins_dedup, FIRST_WINS_DEDUP),
    "dedup_counts": (dedup_counts, DEDUP_COUNTS),
    "dedup_written": (dedup_written, DEDUP_WRITTEN),
    "stored_views": (stored_views, VIEWS_MERGED),
    "attribute_unnest": (attribute_unnest, ATTRIBUTE_UNNEST),
    "union_parts": (union_parts, UNION_PARTS),
    "labels_metadata_join": (labels_metadata_join, LABELS_METADATA_JOIN),
    "line_numbers": (line_numbers, LINE_NUMBERS),
    "line_offsets": (line_offsets, LINE_OFFSETS),
    "csv_roundtrip": (csv_roundtrip, CSV_ROUNDTRIP),
    "json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP),
    "shape_relevance": (shape_relevance, SHAPE_RELEVANCE),
    "shape_detection": (shape_detection, SHAPE_DETECTION),
    "build_tally": (build_tally, BUILD_TALLY),
    "views_roundtrip": (views_roundtrip, VIEWS_ROUNDTRIP),
    "extraction_parts": (extraction_parts, EXTRACTION_PARTS),
    "strip_text": (strip_text, STRIP_TEXT),
}
