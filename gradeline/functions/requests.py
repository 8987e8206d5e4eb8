"""Request bodies, responses and message lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def user_turn(*fields: Column | str) -> Column:
    """A row as the compact JSON a model is shown; NULL fields are left out."""
    return F.to_json(F.struct(*fields))


def request_body(
    slug: Column,
    system: Column,
    user: Column,
    max_tokens: int,
    provider: Column | None = None,
    template_options: Column | None = None,
    thinking: str | None = None,
) -> Column:
    """Body of one call. A remote model is pinned to its provider; a local one gets chat-template
    options instead. The reasoning effort is present only when asked for."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    fields = [
        F.array(turn("system", system), turn("user", user)).alias("messages"),
        slug.alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
    ]
    if template_options is not None:
        fields.append(template_options.alias("chat_template_kwargs"))
    elif provider is not None:
        fields.append(
            F.struct(F.array(provider).alias("only"), F.lit(False).alias("allow_fallbacks")).alias("provider")
        )
    if thinking:
        fields.append(F.struct(F.lit(thinking).alias("effort")).alias("reasoning"))
    return F.struct(*fields)


def apply_reasoning(request: Column) -> Column:
    """Move ``reasoning_effort`` into ``reasoning.effort``, unless ``reasoning`` is already set."""
    effort = request["reasoning_effort"]
    moved = F.coalesce(request["reasoning"], F.when(effort.isNotNull(), F.struct(effort.alias("effort"))))
    return request.withField("reasoning", moved).dropFields("reasoning_effort")


def reply_content(response: Column) -> Column:
    """Content of the first choice, NULL when any step is absent."""
    return F.get(response["choices"], F.lit(0))["message"]["content"]


def prediction_text(response: Column, raw: Column) -> Column:
    """The reply, or the whole response text where there is none (it then parses as no answer)."""
    return F.coalesce(reply_content(response), raw)


def first_turn(messages: Column, role: str) -> Column:
    """Content of the first message with ``role``, NULL when there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def prompt_completion(system: Column, user: Column, answer: Column) -> Column:
    """Training struct: prompt turns, completion turn, template options."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.struct(
        F.array(turn("system", system), turn("user", user)).alias("prompt"),
        F.array(turn("assistant", answer)).alias("completion"),
        F.struct(F.lit(False).alias("enable_thinking")).alias("chat_template_kwargs"),
    )
