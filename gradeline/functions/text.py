"""Text clean-up with the same results as Python's string methods."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Every character Python counts as whitespace, and what it ends lines at.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Python's word characters are letters and numbers (Java's also take in combining marks); the
# look-ahead comes first because it is cheap and fails at most positions
_ARTICLES = r"(?=[at])(?<![\p{L}\p{N}])(a|an|the)(?![\p{L}\p{N}])"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks, in that order.

    Punctuation goes before articles, so that ``th.e`` counts as an article.
    """
    # one pass deletes punctuation and makes every kind of whitespace a blank
    odd = WHITESPACE.replace(" ", "")
    bare = F.translate(F.lower(text), odd + string.punctuation, " " * len(odd))
    spaced = F.regexp_replace(bare, _ARTICLES, " ")
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def quote_json(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def one_line(text: Column) -> Column:
    """A prediction as one line of a text file: quoted as JSON when it holds a line break."""
    return F.when(text.rlike("[\r\n]"), quote_json(text)).otherwise(text)


def count_words(text: Column) -> Column:
    """Blank-separated tokens; the default where no tokenizer is given."""
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+"))).cast("long")
