"""Byte-level BPE by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; as the pattern only
looks forward, two neighbours agree from the first boundary that both have in their overlap, and are
stitched there. The pre-tokens are then merged by the ranks. Decoding concatenates the raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import map_arrow

#: How many code points after a boundary the pattern may need to see to have set it.
LOOK_AHEAD = 3
#: Distinct pre-tokens whose ids a task remembers before it starts anew.
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ids from a rank file: base64 and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece) of the overlapping chunks of a text; one empty piece of an empty text."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    return [(s, text[s : s + chunk + overlap]) for s in starts]


def pretokens(compiled: regex.Pattern, text: str) -> list[str]:
    return compiled.findall(text)


def stitch(
    compiled: regex.Pattern, chunks: list[tuple[int, str]], found: list[list[str]]
) -> list[str]:
    """Pre-tokens of the whole text from those of its chunks.

    The left side is right up to LOOK_AHEAD before its end. If the right chunk shares no boundary
    with it there (one pre-token fills the overlap), both are joined from the last sure boundary and
    pre-tokenised again, so the result never depends on the chunk size.
    """
    tokens, end = list(found[0]), len(chunks[0][1])
    for (start, piece), right in zip(chunks[1:], found[1:]):
        at, back = end, []
        while tokens and at > end - LOOK_AHEAD:  # the last ones may be cut
            back.append(tokens.pop())
            at -= len(back[-1])
        ends = {at: len(tokens)}
        k, p = len(tokens), at
        while k and p > start:
            k -= 1
            p -= len(tokens[k])
            ends[p] = k
        p, meet = start, None
        for j, token in enumerate(right):
            if p > at:
                break
            if p in ends:
                meet = j
                break
            p += len(token)
        if meet is None:
            tail = "".join(reversed(back))  # from the sure boundary ``at`` to the left side's end
            tokens += pretokens(compiled, tail + piece[end - start :])
        else:
            del tokens[ends[p] :]
            tokens += right[meet:]
        end = start + len(piece)
    return tokens


def _encoder(ranks_path: str) -> Callable[[list[str]], bytes]:
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers."""
    import tiktoken

    whole = tiktoken.Encoding(
        "ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={}
    )
    known: dict[str, bytes] = {"": b""}

    def encode(tokens: list[str]) -> bytes:
        missing = set(tokens).difference(known)
        if missing:
            if len(known) > CACHE:
                known.clear()
                missing = set(tokens)
            for token in missing:
                known[token] = np.array(whole.encode_ordinary(token), dtype="<u4").tobytes()
        return b"".join(map(known.__getitem__, tokens))

    return encode


def encode(
    docs: DataFrame,
    key: str,
    text: str,
    ranks_path: str,
    pattern: str,
    chunk: int = 2048,
    overlap: int = 256,
    spread: int = 4_000_000,
) -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit ids) of every row's whole text.

    A NULL text counts as empty: no ids. Rows with equal keys stay separate rows; a NULL key stays
    NULL. Other columns are not read. The chunks of a text up to ``spread`` code points are done in
    one task; longer texts have their chunks dealt over all tasks and are stitched per text.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > spread

    def start():
        compiled, ids_of = regex.compile(pattern), _encoder(ranks_path)

        def step(columns):
            out = []
            for t in columns[1]:
                chunks = cut(t, chunk, overlap)
                out.append(ids_of(stitch(compiled, chunks, [pretokens(compiled, c) for _, c in chunks])))
            return [columns[0], out]

        return step

    kind = dict(rows.dtypes)["key"]
    within = map_arrow(rows.where(~long), f"key {kind}, ids binary", start)
    beyond = _spread(rows.where(long), kind, ranks_path, pattern, spread // 4, overlap)
    return within.unionByName(beyond).select(F.col("key").alias(key), "ids")


def _spread(
    rows: DataFrame, kind: str, ranks_path: str, pattern: str, chunk: int, overlap: int
) -> DataFrame:
    """The same for very long texts: a row per chunk, dealt out, pre-tokenised, stitched per text."""

    def cutter():
        def step(columns):
            out = [[], [], [], []]
            for key, row, t in zip(*columns):
                for s, piece in cut(t, chunk, overlap):
                    for column, value in zip(out, (key, row, s, piece)):
                        column.append(value)
            return out

        return step

    def splitter():
        compiled = regex.compile(pattern)

        def step(columns):
            sizes = [
                np.fromiter(map(len, pretokens(compiled, t)), dtype="<u4").tobytes() for t in columns[3]
            ]
            return [*columns, sizes]

        return step

    def join(found):
        import pyarrow as pa

        order = found.sort_by("start").to_pydict()
        compiled, chunks, tokens = regex.compile(pattern), [], []
        for s, piece, sizes in zip(order["start"], order["piece"], order["sizes"]):
            ends = np.cumsum(np.frombuffer(sizes, dtype="<u4")).tolist()
            chunks.append((s, piece))
            tokens.append([piece[a:b] for a, b in zip([0, *ends], ends)])
        ids = _encoder(ranks_path)(stitch(compiled, chunks, tokens))
        return pa.table({"key": found.column("key")[:1], "ids": pa.array([ids], type=pa.binary())})

    marked = rows.select("key", F.monotonically_increasing_id().alias("row"), "text")
    dealt = map_arrow(marked, f"key {kind}, row bigint, start bigint, piece string", cutter)
    dealt = dealt.repartition("row", "start")
    split = map_arrow(dealt, f"key {kind}, row bigint, start bigint, piece string, sizes binary", splitter)
    return split.groupBy("row").applyInArrow(join, f"key {kind}, ids binary")


def decode(encoded: DataFrame, key: str, ids: str, ranks_path: str) -> DataFrame:
    """``key``, ``bytes``: the raw bytes of each row's ids, concatenated. NULL ids give NULL.

    The bytes of a whole text are its UTF-8; those of a part may end inside a character, so they
    stay binary. An id without a rank raises.
    """
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def start():
        ranks = read_ranks(ranks_path)
        parts = np.full(max(ranks.values()) + 1, None, dtype=object)
        for raw, rank in ranks.items():
            parts[rank] = raw

        def step(columns):
            out = [
                None if i is None else b"".join(parts[np.frombuffer(i, dtype="<u4")].tolist())
                for i in columns[1]
            ]
            return [columns[0], out]

        return step

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, bytes binary", start).select(F.col("key").alias(key), "bytes")


def round_trip(docs: DataFrame, key: str, text: str, ranks_path: str, pattern: str, **cuts: int) -> DataFrame:
    """``key``, ``ids`` and ``bytes`` of every row: encoded, then decoded in the same task order."""
    encoded = encode(docs, key, text, ranks_path, pattern, **cuts)
    both = encoded.select(F.struct(key, "ids").alias("key"), "ids")
    return decode(both, "key", "ids", ranks_path).select(f"key.{key}", "key.ids", "bytes")
