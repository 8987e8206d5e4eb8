"""The three task kinds and what differs between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from gradeline import blocklists
from gradeline.functions.replies import relevance_letter
from gradeline.functions.requests import user_turn
from gradeline.functions.text import strip
from gradeline.operators.detection import score_detection
from gradeline.operators.report import METRIC_PATH
from gradeline.operators.scoring import score_extraction, score_relevance
from gradeline.operators.shaping import RELEVANCE_PRODUCT
from gradeline.schemas import DETECTION_GOLD


@dataclass(frozen=True)
class TaskKind:
    """``parse_reply`` turns a model reply into the line that is stored; ``score`` parses that line
    and compares it with gold, as one row of metrics."""

    name: str
    question_fields: tuple[str, ...]
    gold_fields: tuple[str, ...]
    parse_reply: Callable[[Column], Column]
    score: Callable[[DataFrame, DataFrame], DataFrame]
    blocked_groups: Sequence[Sequence[str]]

    @property
    def metric_path(self) -> str:
        return METRIC_PATH[self.name]

    def questions(self, sample: DataFrame) -> DataFrame:
        """What a labeller may see."""
        return sample.select("idx", *[f for f in self.question_fields if f in sample.columns])

    def gold(self, sample: DataFrame) -> DataFrame:
        """The fields scoring needs; a missing one is an error."""
        return sample.select("idx", *self.gold_fields)

    def prompts(self, questions: DataFrame) -> DataFrame:
        """(idx, prompt): each question as the JSON user turn."""
        shown = [f for f in self.question_fields if f in questions.columns]
        return questions.select("idx", user_turn(*shown).alias("prompt"))


TASKS = {
    task.name: task
    for task in (
        TaskKind(
            "extraction",
            ("attribute", "paragraphs"),
            ("id", "category", "attribute", "evidences"),
            strip,
            score_extraction,
            blocklists.EXTRACTION,
        ),
        TaskKind(
            "relevance",
            ("query", *RELEVANCE_PRODUCT),
            ("example_id", "label", "locale", "large_version", "split"),
            relevance_letter,
            score_relevance,
            blocklists.RELEVANCE,
        ),
        TaskKind("detection", ("text",), DETECTION_GOLD, strip, score_detection, blocklists.DETECTION),
    )
}


def score(gold: DataFrame, preds: DataFrame, kind: str) -> DataFrame:
    """Metrics of a run, one row. ``gold`` as from TaskKind.gold, ``preds``: idx, pred."""
    return TASKS[kind].score(gold, preds)
