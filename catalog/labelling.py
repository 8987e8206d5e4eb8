"""Request, labelling and training-set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import inputs
from catalog.base import derive, plain, table
from gradeline import schemas
from gradeline.functions.requests import first_turn, prediction_text, request_body, user_turn
from gradeline.functions.text import one_line
from gradeline.operators import teacher
from gradeline.plans import labelling, training
from gradeline.session import fresh_path
from gradeline.sources import readers, writers

SYSTEM = 'Say "yes" or "no".'


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- requests -------------------------------------------------------------------------------


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = user_turn("text", F.nullif("lang", F.lit("de")).alias("lang"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(turn).alias("turn_md5"))


USER_TURNS = """
SELECT doc_id, md5(CASE WHEN lang = 'de' THEN to_json({'text': text})::VARCHAR ELSE to_json({'text': text, 'lang': lang})::VARCHAR END) AS turn_md5
FROM documents"""


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    remote = request_body(F.lit("maker/m-1"), F.lit(SYSTEM), F.col("text"), 64, provider=F.col("source"), thinking="low")
    local = request_body(F.lit("student"), F.lit(SYSTEM), F.col("text"), 64, template_options=F.struct(F.lit(False).alias("enable_thinking")))
    return docs.select("doc_id", F.md5(F.to_json(remote)).alias("remote_md5"), F.md5(F.to_json(local)).alias("local_md5"))


_MESSAGES = f"""'messages': [{{'role': 'system', 'content': '{SYSTEM}'}}, {{'role': 'user', 'content': text}}]"""
REQUEST_BODIES = f"""
SELECT doc_id, md5(to_json({{{_MESSAGES}, 'model': 'maker/m-1', 'max_tokens': 64, 'provider': {{'only': [source], 'allow_fallbacks': false}},
    'reasoning': {{'effort': 'low'}}}})::VARCHAR) AS remote_md5,
  md5(to_json({{{_MESSAGES}, 'model': 'student', 'max_tokens': 64, 'chat_template_kwargs': {{'enable_thinking': false}}}})::VARCHAR) AS local_md5
FROM documents"""


def batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch request file of a detection run, written and read back by custom id."""
    questions = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text")
    path = fresh_path(spark, "requests")
    writers.write_batch_requests(labelling.requests(questions, "detection", "maker/m-1", SYSTEM, 1024, "p1"), path)
    back = readers.read_batch_requests(spark, path)
    content = first_turn(F.col("body.messages"), "user")
    return back.select(
        "idx", F.col("body.model").alias("model"), F.col("body.max_tokens").alias("max_tokens"),
        first_turn(F.col("body.messages"), "system").alias("system"), F.md5(content).alias("user_md5"),
    )


BATCH_SCAN = f"""
SELECT doc_id AS idx, 'maker/m-1' AS model, 1024 AS max_tokens, '{SYSTEM}' AS system, md5(to_json({{'text': text}})::VARCHAR) AS user_md5 FROM documents"""


def reply_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of logged responses; one without content stands as its whole text."""
    calls = derive(spark, sf_dir, inputs.CALLS)
    text = prediction_text(F.from_json("body", schemas.RESPONSE), F.col("body"))
    return calls.select("idx", F.md5(text).alias("pred_md5"))


REPLY_CONTENT = f"""
SELECT idx, md5(CASE WHEN body LIKE '{{%' THEN coalesce(json_extract_string(body, '$.choices[0].message.content'), body) ELSE body END) AS pred_md5
FROM ({plain(inputs.CALLS)})"""


def line_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(one_line(F.col("text"))).alias("line_md5"))


LINE_ESCAPE = """
SELECT doc_id, md5(CASE WHEN contains(text, chr(10)) THEN to_json(text)::VARCHAR ELSE text END) AS line_md5 FROM documents"""


# ---- labelling ------------------------------------------------------------------------------


def _length_rule():
    """A stand-in model loader: long texts count as machine text.

    Built inside a function, so that it travels to the workers by value.
    """

    def load():
        def predict(texts):
            return ["0.9" if len(t) > 1200 else "0.2" for t in texts]

        return predict

    return load


def batch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teacher.label_rows(_docs(spark, sf_dir), "text", _length_rule()).select("doc_id", "pred")


BATCH_LABEL = "SELECT doc_id, CASE WHEN length(text) > 1200 THEN '0.9' ELSE '0.2' END AS pred FROM documents"

MAX_TOKENS, WINDOW = 100, 800
_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
_PROMPT = "to_json({'text': text})::VARCHAR"


def local_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local model over the whole detection task; prompts that do not fit become error responses."""
    questions = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text")
    out = labelling.label_locally(questions, "detection", _length_rule(), MAX_TOKENS, WINDOW)
    return out.select("idx", "pred", F.col("response.usage.prompt_tokens").alias("n_tokens"))


LOCAL_RUN = f"""
WITH p AS (SELECT doc_id AS idx, {_PROMPT} AS prompt FROM documents),
n AS (SELECT idx, prompt, CAST({_WORDS.format('prompt')} AS BIGINT) AS n FROM p)
SELECT idx, CASE WHEN n + {MAX_TOKENS} > {WINDOW} THEN '{{"error":{{"message":"prompt of ' || n || ' tokens plus max_tokens {MAX_TOKENS} exceeds max_model_len {WINDOW}"}}}}'
  WHEN length(prompt) > 1200 THEN '0.9' ELSE '0.2' END AS pred, CASE WHEN n + {MAX_TOKENS} <= {WINDOW} THEN n END AS n_tokens FROM n"""


def window_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = teacher.window_fit(_docs(spark, sf_dir), F.col("text"), MAX_TOKENS, WINDOW)
    return sized.select("doc_id", "n_tokens", "fits", "error")


_N = f"CAST({_WORDS.format('text')} AS BIGINT)"
WINDOW_FIT = f"""
WITH n AS (SELECT doc_id, {_N} AS n_tokens FROM documents)
SELECT doc_id, n_tokens, n_tokens + {MAX_TOKENS} <= {WINDOW} AS fits, CASE WHEN n_tokens + {MAX_TOKENS} > {WINDOW}
  THEN 'prompt of ' || n_tokens || ' tokens plus max_tokens {MAX_TOKENS} exceeds max_model_len {WINDOW}' END AS error FROM n"""


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teacher.within_length(_docs(spark, sf_dir), F.col("text"), 200).select("doc_id", "n_tokens")


LENGTH_FILTER = f"SELECT doc_id, {_N} AS n_tokens FROM documents WHERE {_N} <= 200"


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of a supplied tokenizer."""

    def load():
        return lambda texts: [len(text.split()) for text in texts]

    count = teacher.token_counter(load)
    return _docs(spark, sf_dir).select("doc_id", count(F.col("text")).alias("n_tokens"))


TOKEN_COUNT = f"SELECT doc_id, {_N} AS n_tokens FROM documents"


# ---- training rows --------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derive(spark, sf_dir, inputs.TEACHER_PARTS)

    def turn(role: str, column: str):
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(role).alias("role"), F.col(column).alias("content")))

    messages = F.array_compact(F.array(turn("system", "system_text"), turn("user", "user_text")))
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")).alias("message"))
    return parts.select("idx", F.struct(messages.alias("messages")).alias("request"), F.struct(F.array(choice).alias("choices")).alias("response"))


_TEACHER_CTE = f"""
WITH t AS ({plain(inputs.TEACHER_PARTS)}),
rows AS (SELECT *, CASE WHEN system_text IS NULL THEN 'no system turn' WHEN user_text IS NULL THEN 'no user turn'
  WHEN answer IS NULL THEN 'no reply' END AS skipped FROM t)"""


def teacher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = teacher.teacher_rows(_records(spark, sf_dir))
    return rows.select("idx", *[F.md5(c).alias(c) for c in ("system", "user", "teacher")], "skipped")


TEACHER_ROWS = f"{_TEACHER_CTE} SELECT idx, md5(system_text) AS system, md5(user_text) AS user, md5(answer) AS teacher, skipped FROM rows"


def teacher_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teacher.teacher_counts(teacher.teacher_rows(_records(spark, sf_dir)))


TEACHER_COUNTS = f"{_TEACHER_CTE} SELECT count(*) FILTER (skipped IS NULL) AS n_kept, count(*) FILTER (skipped IS NOT NULL) AS n_skipped FROM rows"


def teacher_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher labels with the task's question, by index into the sample."""
    questions = _docs(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text", "lang")
    joined = teacher.attach_questions(teacher.teacher_rows(_records(spark, sf_dir)), questions)
    return joined.select("idx", "lang", F.md5("text").alias("text_md5"), F.md5("teacher").alias("teacher"))


TEACHER_QUESTIONS = f"""{_TEACHER_CTE}
SELECT idx, lang, md5(text) AS text_md5, md5(answer) AS teacher FROM rows JOIN documents ON doc_id = idx"""


def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = teacher.training_rows(teacher.kept_rows(teacher.teacher_rows(_records(spark, sf_dir))))
    return rows.select("idx", F.md5(F.to_json(F.struct("prompt", "completion", "chat_template_kwargs"))).alias("row_md5"))


PROMPT_COMPLETION = f"""{_TEACHER_CTE}
SELECT idx, md5(to_json({{'prompt': [{{'role': 'system', 'content': system_text}}, {{'role': 'user', 'content': user_text}}],
  'completion': [{{'role': 'assistant', 'content': answer}}], 'chat_template_kwargs': {{'enable_thinking': false}}}})::VARCHAR) AS row_md5
FROM rows WHERE skipped IS NULL"""


def training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and held-out sets written by part and read back."""
    path = fresh_path(spark, "training")
    writers.write_training_sets(training.training_sets(_records(spark, sf_dir), 0.25, 3), path)
    schema = "idx BIGINT, prompt ARRAY<STRUCT<role: STRING, content: STRING>>, completion ARRAY<STRUCT<role: STRING, content: STRING>>, part STRING"
    back = spark.read.schema(schema).json(path)
    return back.select("idx", "part", F.md5(first_turn(F.col("prompt"), "user")).alias("user"), F.md5(F.col("completion")[0]["content"]).alias("teacher"))


TRAINING_SETS = f"""{_TEACHER_CTE}, kept AS (SELECT * FROM rows WHERE skipped IS NULL)
SELECT idx, CASE WHEN row_number() OVER (ORDER BY md5(concat('3:', idx)), idx) <= floor((SELECT count(*) FROM kept) * 0.25::DOUBLE) THEN 'eval' ELSE 'train' END AS part,
  md5(user_text) AS user, md5(answer) AS teacher FROM kept"""


def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of every source's sweep: documents as sweep points, ties on the loss included."""
    points = _docs(spark, sf_dir).select(
        "source", F.col("doc_id").alias("seq"), (F.col("n_chars") % 40 / F.lit(40.0)).alias("eval_loss"),
        F.concat(F.lit("run/"), F.col("doc_id").cast("string")).alias("student_dir"),
    )
    return teacher.best_point(points, by=["source"])


SWEEP_BEST = """
SELECT source, doc_id AS seq, (n_chars % 40) / 40.0::DOUBLE AS eval_loss, 'run/' || doc_id AS student_dir FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars % 40, doc_id) = 1"""

QUERIES = {
    "user_turns": (user_turns, USER_TURNS),
    "request_bodies": (request_bodies, REQUEST_BODIES),
    "batch_scan": (batch_scan, BATCH_SCAN),
    "reply_content": (reply_content, REPLY_CONTENT),
    "line_escape": (line_escape, LINE_ESCAPE),
    "batch_label": (batch_label, BATCH_LABEL),
    "local_run": (local_run, LOCAL_RUN),
    "window_fit": (window_fit, WINDOW_FIT),
    "length_filter": (length_filter, LENGTH_FILTER),
    "token_count": (token_count, TOKEN_COUNT),
    "teacher_rows": (teacher_rows, TEACHER_ROWS),
    "teacher_counts": (teacher_counts, TEACHER_COUNTS),
    "teacher_questions": (teacher_questions, TEACHER_QUESTIONS),
    "prompt_completion": (prompt_completion, PROMPT_COMPLETION),
    "training_sets": (training_sets, TRAINING_SETS),
    "sweep_best": (sweep_best, SWEEP_BEST),
}
