"""Free-text model replies to values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeline.functions.text import normalize_answer, strip

# The four relevance letters with their label names, in drawing order.
RELEVANCE_LABELS = {"E": "Exact", "S": "Substitute", "C": "Complement", "I": "Irrelevant"}
NO_VALUE = "<NO_VALUE>"
CHANCE = 0.5

_DIGITS = r"[0-9](?:_?[0-9])*"
_FLOAT = rf"(?i)^[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:e[+-]?{_DIGITS})?\z"


def relevance_letter(reply: Column) -> Column:
    """A bare E, S, C or I in any case; anything else is the empty string."""
    letter = F.upper(strip(F.coalesce(reply, F.lit(""))))
    return F.when(letter.isin(*RELEVANCE_LABELS), letter).otherwise("")


def relevance_label(letter: Column) -> Column:
    """The label name of a letter, NULL for anything else."""
    names = F.create_map(*[F.lit(text) for pair in RELEVANCE_LABELS.items() for text in pair])
    return F.try_element_at(names, letter)


def fallback_letter(key: Column, seed: int = 0) -> Column:
    """One uniform letter per key and seed, without a lookup table."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    draw = F.conv(head, 16, 10).cast("bigint") % len(RELEVANCE_LABELS)
    letters = F.array(*[F.lit(letter) for letter in RELEVANCE_LABELS])
    return F.element_at(letters, (draw + 1).cast("int"))


def reply_number(reply: Column) -> Column:
    """A bare number as Python's float() reads it; NULL for anything else, nan and inf included."""
    # Spark's cast takes 0.5f and rejects 0_5, so the pattern decides; no match leaves ''
    literal = F.regexp_extract(strip(reply), _FLOAT, 0)
    return F.replace(literal, F.lit("_"), F.lit("")).try_cast("double")


def confidence(number: Column) -> Column:
    """The number if it is in [0, 1], else chance."""
    # adding zero turns -0.0 into 0.0
    return F.when((number >= 0.0) & (number <= 1.0), number + F.lit(0.0)).otherwise(F.lit(CHANCE))


def detection_score(reply: Column) -> Column:
    """A bare number in [0, 1]; anything else scores as chance."""
    return confidence(reply_number(reply))


def extraction_value(reply: Column) -> Column:
    """The bare value; the marker for "no value" becomes the empty string."""
    bare = strip(reply)
    return F.when(bare == NO_VALUE, "").otherwise(bare)


def gold_values(evidences: Column) -> Column:
    """Normalised, non-empty values of an array of evidences (struct with ``value``)."""
    return F.filter(F.transform(evidences, lambda e: normalize_answer(e["value"])), lambda v: v != "")


def extraction_outcome(gold: Column, guess: Column) -> Column:
    """Outcome class from ``gold_values`` and the normalised prediction.

    First letter: does gold state a value; second: none predicted, the same one, or another one.
    """
    no_gold, no_guess = F.size(gold) == 0, guess == ""
    return (
        F.when(no_gold & no_guess, "n_n")
        .when(no_gold, "n_a")
        .when(no_guess, "a_n")
        .when(F.array_contains(gold, guess), "a_a")
        .otherwise("a_b")
    )
