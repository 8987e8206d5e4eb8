"""Agent event lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeline import schemas

# Fixed value: the prefix of every formatted line.
PREFIX = "opencode"


def parse_event(line: Column) -> Column:
    return F.from_json(line, schemas.AGENT_EVENT)


def format_event(line: Column, prefix: str = PREFIX) -> Column:
    """One log line per event; a line that is not a JSON object passes through unchanged."""
    event = parse_event(line)
    kind = F.coalesce(event["type"], F.lit("unknown"))
    session = F.coalesce(event["sessionID"], F.lit("unknown"))
    part = event["part"]
    part_kind = F.coalesce(part["type"], F.lit(""))
    text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\n"), F.lit(" "))
    tool = F.coalesce(part["tool"], F.lit("unknown"))
    command = F.get_json_object(part["state"]["input"], "$.command")
    status = F.coalesce(part["state"]["status"], F.lit("unknown"))

    def tagged(tag: Column | str, rest: Column) -> Column:
        return F.concat(F.lit(f"[{prefix}/"), F.lit(tag) if isinstance(tag, str) else tag, F.lit("]"), rest)

    def spaced(value: Column) -> Column:
        return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(" "), value))

    return (
        F.when(F.json_object_keys(line).isNull(), line)
        .when(kind.isin("step_start", "step_finish"), tagged(kind, F.concat(F.lit(" session="), session)))
        .when(part_kind.isin("text", "reasoning"), tagged(part_kind, spaced(text)))
        .when(
            (part_kind == "tool") & (tool == "bash") & (F.coalesce(command, F.lit("")) != ""),
            tagged("tool_use", F.concat(F.lit(" "), tool, F.lit(" command="), command)),
        )
        .when(
            part_kind == "tool",
            tagged("tool_use", F.concat(F.lit(" "), tool, F.lit(" status="), status)),
        )
        .otherwise(tagged(kind, F.concat(F.lit(" "), line)))
    )
