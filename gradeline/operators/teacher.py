"""Label-set preparation from raw call records, and labelling with a supplied predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.functions.requests import first_turn, prompt_completion, reply_content
from gradeline.functions.text import count_words

#: Rows of one model call.
LOCAL_CHUNK = 50_000
#: Code points of prompts after which a call is made with fewer rows, so that a task holds few at once.
CALL_CHARS = 1 << 22


def teacher_rows(records: DataFrame) -> DataFrame:
    """idx, system, user, teacher, and ``skipped`` (why a record is no training row; NULL if it is)."""
    messages = F.col("request.messages")
    rows = records.select(
        "idx",
        first_turn(messages, "system").alias("system"),
        first_turn(messages, "user").alias("user"),
        reply_content(F.col("response")).alias("teacher"),
    )
    skipped = (
        F.when(F.col("system").isNull(), "no system turn")
        .when(F.col("user").isNull(), "no user turn")
        .when(F.col("teacher").isNull(), "no reply")
    )
    return rows.withColumn("skipped", skipped)


def kept_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("skipped").isNull()).drop("skipped")


def teacher_counts(rows: DataFrame) -> DataFrame:
    """Records kept, and skipped for an empty reply or a missing turn."""
    return rows.agg(
        F.count_if(F.col("skipped").isNull()).alias("n_kept"),
        F.count_if(F.col("skipped").isNotNull()).alias("n_skipped"),
    )


def attach_questions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Teacher labels with the task's question they were given for, by index."""
    return rows.join(questions, "idx")


def training_rows(rows: DataFrame) -> DataFrame:
    """idx (and ``part``, if the rows are split) with prompt, completion and template options."""
    kept = [c for c in ("idx", "part") if c in rows.columns]
    return rows.select(
        *kept, prompt_completion(F.col("system"), F.col("user"), F.col("teacher")).alias("row")
    ).select(*kept, "row.*")


def token_counter(load: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """Count tokens with any tokenizer; ``load`` runs once per task and returns texts -> their counts.

    The function gets a whole Arrow batch, as tokenizers want it; a NULL text stays NULL.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = load()
        for batch in batches:
            asked = batch.dropna()
            yield pd.Series(tokens(asked.tolist()), index=asked.index, dtype="object").reindex(batch.index)

    return count


def within_length(
    df: DataFrame, text: Column, max_length: int, count: Callable[[Column], Column] = count_words
) -> DataFrame:
    """Rows whose text has at most ``max_length`` tokens; adds ``n_tokens``."""
    return df.withColumn("n_tokens", count(text)).where(F.col("n_tokens") <= max_length)


def window_fit(
    df: DataFrame,
    prompt: Column,
    max_tokens: int,
    max_model_len: int,
    count: Callable[[Column], Column] = count_words,
) -> DataFrame:
    """Mark prompts that leave no room for ``max_tokens``: ``n_tokens``, ``fits``, ``error``.

    Rows are kept: an unfit prompt gets an error response, which scores as no answer.
    """
    sized = df.withColumn("n_tokens", count(prompt))
    fits = F.col("n_tokens") + max_tokens <= max_model_len
    text = F.concat(
        F.lit("prompt of "), F.col("n_tokens").cast("string"),
        F.lit(f" tokens plus max_tokens {max_tokens} exceeds max_model_len {max_model_len}"),
    )
    return sized.withColumn("fits", fits).withColumn("error", F.when(~fits, text))


def label_rows(
    df: DataFrame, prompt: str, make_predict: Callable[[], Callable], chunk: int = LOCAL_CHUNK
) -> DataFrame:
    """Add ``pred``: a supplied model's reply to each prompt, ``chunk`` rows per model call.

    ``make_predict`` runs once per task and returns array of prompts -> sequence of replies; one
    that caches its model in an importable module loads it once per worker. A task gathers the
    prompts alone until it has ``chunk`` rows, or CALL_CHARS of text before that; its last call has
    what is left. A NULL prompt gets NULL without a call. Rows keep their columns, which Python does
    not see, so the order is whatever ``idx`` says. Each evaluation asks the model again: write the
    result before using it twice.
    """

    def answered(model: Callable, prompts: list[str | None]) -> pa.Array:
        asked = [i for i, p in enumerate(prompts) if p is not None]
        replies = [None] * len(prompts)
        if asked:
            texts = np.empty(len(asked), dtype=object)
            texts[:] = [prompts[i] for i in asked]
            for i, reply in zip(asked, model(texts)):
                replies[i] = reply
        return pa.array(replies, pa.string())

    @F.arrow_udf("string")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, held, chars = None, [], 0
        for batch in batches:
            model = model or make_predict()
            for value in batch:  # one by one: a batch's rows may be long too
                text = value.as_py()
                held.append(text)
                chars += len(text) if isinstance(text, str) else 0
                if len(held) >= chunk or chars >= CALL_CHARS:
                    yield answered(model, held)
                    held, chars = [], 0
        if held:
            yield answered(model, held)

    # not deterministic: the planner neither repeats a call nor moves one
    return df.drop("pred").withColumn("pred", predict.asNondeterministic()(F.col(f"`{prompt}`")))


def local_response(text: Column, error: Column, n_prompt: Column, n_reply: Column) -> Column:
    """Response document of a local model: a choice with usage, or an error."""
    choice = F.struct(
        F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"),
        F.lit("stop").alias("finish_reason"),
    )
    usage = F.struct(
        n_prompt.alias("prompt_tokens"), n_reply.alias("completion_tokens"),
        (n_prompt + n_reply).alias("total_tokens"),
    )
    answered = error.isNull()
    return F.to_json(
        F.struct(
            F.when(answered, F.array(choice)).alias("choices"),
            F.when(answered, usage).alias("usage"),
            F.when(~answered, F.struct(error.alias("message"))).alias("error"),
        )
    )


def best_point(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sweep point with the lowest eval_loss, the earliest on ties."""
    fields = [c for c in sweep.columns if c not in (by or [])]
    best = F.min_by(F.struct(*fields), F.struct("eval_loss", "seq")).alias("best")
    return sweep.groupBy(*(by or [])).agg(best).select(*(by or []), "best.*")
