"""Predicates over request URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The billed chat endpoint.
CHAT_HOST = "openrouter.ai"
CHAT_PATH = "/api/v1/chat/completions"

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOOPBACK_V4 = rf"(127([.]{_OCTET}){{3}}|0[.]0[.]0[.]0)"
# all groups zero but for a last one of 0 or 1: written out, or with one run of zeros left out
_LOOPBACK_V6 = r"((0{1,4}:){7}0{0,3}[01]|(0{1,4}(:0{1,4}){0,6})?::((0{1,4}:){0,6}0{0,3}[01])?)"
_LOOPBACK = rf"^({_LOOPBACK_V4}|\[?({_LOOPBACK_V6}|::ffff:127([.]{_OCTET}){{3}})\]?)\z"


def blocked_group(url: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Position of the first group all of whose substrings occur in the URL, NULL if none does.

    One generated branch per group; the groups are a fixed list, so this needs no join.
    """
    lowered = F.lower(url)
    found = F.lit(None).cast("int")
    for position, group in reversed(list(enumerate(groups))):
        hit = F.lit(True)
        for part in group:
            hit = hit & F.contains(lowered, F.lit(part.lower()))
        found = F.when(hit, F.lit(position)).otherwise(found)
    return found


def group_text(position: Column, groups: Sequence[Sequence[str]]) -> Column:
    """A group's substrings joined by blanks, for reports."""
    texts = F.array(*[F.lit(" ".join(g)) for g in groups]) if groups else F.array(F.lit(""))
    return F.when(position.isNotNull(), F.get(texts, position))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def is_loopback(host: Column) -> Column:
    """A loopback or unspecified address, or a name that mentions localhost."""
    name = F.coalesce(host, F.lit(""))
    return F.lower(name).rlike(_LOOPBACK) | F.contains(F.lower(name), F.lit("localhost"))


def is_chat_call(host: Column, method: Column, path: Column) -> Column:
    """A POST to the chat endpoint; the query string does not matter."""
    bare = F.split_part(path, F.lit("?"), F.lit(1))
    return F.coalesce((host == CHAT_HOST) & (method == "POST") & (bare == CHAT_PATH), F.lit(False))
