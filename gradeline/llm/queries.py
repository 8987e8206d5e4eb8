"""The registered queries of this package: name -> (query, oracle statement or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeline.llm import bisector, bpe, compression, language, lines, packing, pii, runs, secrets, simhash, sketch, topk, toxicity
from gradeline.llm.common import fold, table


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    text = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    return F.concat_ws(",", F.transform(spans, text))


def _digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count per base kind, the hash of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s.base) if "base" in found.schema["spans"].dataType.elementType.names else (
        F.filter("spans", lambda s: s.kind.isin(*kinds))
    )

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


#: Texts of each language that the classifiers are fitted on.
LANGUAGE_SAMPLE = 300


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(fold(F.col("doc_id"), 4) != 2), "text", "lang", LANGUAGE_SAMPLE)
    found = language.identify(docs, "doc_id", "text", model)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.edited_sketches(table(spark, sf_dir, "documents"), "doc_id", "text")
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(own).alias("fingerprint"),
        sketch.as_text(edited).alias("edited_fingerprint"),
        F.coalesce(sketch.containment(own, edited), F.lit(0.0)).alias("near_edited"),
        F.coalesce(sketch.containment(own, after), F.lit(0.0)).alias("near_next"),
        sketch.resemblance(own, edited).alias("resembles_edited"),
        sketch.resemblance(own, after).alias("resembles_next"),
    )


#: Texts of each label that the secret models are fitted on.
SECRET_SAMPLE = 2000


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.Ratio(*secrets.samples(docs, "text", SECRET_SAMPLE))
    found = secrets.find_secrets(docs, "doc_id", "text", model)
    return _digests(found, ("assign", "access", "hex"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, distance=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


#: Texts that the personal data tagger is trained on.
PII_SAMPLE = 800


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pii.learn(docs, "text", PII_SAMPLE)
    return _digests(pii.find_personal(docs, "doc_id", "text", model), pii.KINDS)


#: A line on so many sites is boilerplate.
LEAST_SITES = 8


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.remove_boilerplate(docs, "text", "source", LEAST_SITES, counted="n_chars")
    return kept.select(
        "doc_id", F.length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


OP6_SQL = f"""
WITH lines AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents
), spread AS (
  SELECT line FROM lines WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {LEAST_SITES}
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), cut AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM numbered
), short AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY place)
    FILTER (trim(line, ' ') NOT IN (SELECT line FROM spread)), '') AS text,
    count(*) FILTER (trim(line, ' ') <> '' AND trim(line, ' ') NOT IN (SELECT line FROM spread)) AS own
  FROM cut GROUP BY r
), kept AS (
  SELECT doc_id, CASE WHEN own = 0 AND count(*) OVER (PARTITION BY n.text) > 1 THEN n.text ELSE s.text END AS text
  FROM numbered n LEFT JOIN short s USING (r)
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS kept_chars, md5(text) AS kept_md5 FROM kept
"""


#: Labelled texts of each label that the toxicity classifier is fitted on.
TOXIC_SAMPLE = 1500


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.learn(docs, learned, "doc_id", "text", "toxic", TOXIC_SAMPLE)
    found = toxicity.score(docs, "doc_id", "text", model)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.round_trip(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", words, end_id=1, window=2048)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20, scale=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP10_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0)
      AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""



def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs, "doc_id", "text", least=6, exponent=4, edit=runs.repeat_tail)
    order = lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))
    best = F.array_min(F.transform("runs", order))
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        (-F.col("best.length")).alias("length"),
        "best.period",
        F.expr("1000 * -best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compression.judge_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("in_bands")).alias("kept"), "ratio", "outside",
    )


#: Clusters and rounds of the centroid clustering.
CLUSTERS, ROUNDS = 8, 10


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bisector.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=CLUSTERS, rounds=ROUNDS)
    centroid = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(centroid, 256).alias("centroid_sha256")
    )


def _op13_sql() -> str:
    """The rounds one after the other: centroids c0, c1, ... and the assignments a0, a1, ... to them."""
    assigned = """a{0} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT r, vec_id, v, cluster,
      CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance
    FROM kept, c{0}
  ) GROUP BY r, vec_id, v
)"""
    moved = """c{1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c FROM c{0} o LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS c FROM (
      SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{0}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)"""
    steps = [part.format(i, i + 1) for i in range(ROUNDS) for part in (assigned, moved)]
    steps.append(assigned.format(ROUNDS))
    body = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {CLUSTERS}
),
{body}
SELECT vec_id, cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_scaled_sketch": (op2_scaled_sketch, None),
    "op3_simhash": (op3_simhash, None),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op4_secrets": (op4_secrets, None),
    "op5_pii": (op5_pii, None),
    "op6_line_dedup": (op6_line_dedup, OP6_SQL),
    "op7_toxicity": (op7_toxicity, None),
    "op9_packing": (op9_packing, None),
    "op10_top_k": (op10_top_k, OP10_SQL),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_quality_rules": (op12_quality_rules, None),
    "op13_centroid_clusters": (op13_centroid_clusters, _op13_sql()),
}
