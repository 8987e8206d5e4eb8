"""Quality by compression: zstandard ratios of whole texts and of fixed chunks within bands by length.

Text that repeats itself compresses too well, random or encoded text not at all. The shorter a text,
the less there is to compress and the more a frame weighs, so every length has limits of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import map_arrow

#: Code points that prose seldom uses.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio) by rising length, and how chunks are judged.

    A ratio is compressed by plain bytes. Texts shorter than the first band are not judged. A text is
    rejected if its ratio is outside its band, or if over ``most_outside`` of its bytes lie in chunks
    of ``chunk`` bytes (the last one shorter) that are outside theirs.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (64, 0.35, 1.3), (128, 0.3, 1.05), (512, 0.27, 0.9), (2048, 0.24, 0.8), (8192, 0.2, 0.75), (65536, 0.15, 0.72),
    )
    chunk: int = 2048
    most_outside: float = 0.3
    level: int = 3

    def band(self, size: int) -> tuple[float, float] | None:
        found = [(low, high) for least, low, high in self.limits if size >= least]
        return found[-1] if found else None

    def outside(self, size: int, packed: int) -> bool:
        band = self.band(size)
        return band is not None and not band[0] <= packed / size <= band[1]

    def judge(self, raw: bytes, packed: list[int]) -> tuple[float | None, float, bool]:
        """Ratio of the whole, share of bytes in chunks outside their band, verdict: whether it is kept.

        ``packed`` are the compressed sizes of the whole and of its chunks.
        """
        if not raw:
            return None, 0.0, True
        sizes = [min(self.chunk, len(raw) - a) for a in range(0, len(raw), self.chunk)]
        odd = sum(size for size, now in zip(sizes, packed[1:]) if self.outside(size, now)) / len(raw)
        return packed[0] / len(raw), odd, not self.outside(len(raw), packed[0]) and odd <= self.most_outside


def repeated_words(words: list, window: int = 3) -> int:
    """How many of ``words`` are in a run of ``window`` words that occurs twice or more."""
    if len(words) < window:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    codes = ids
    for step in range(1, window):  # a code never exceeds words * different words
        _, codes = np.unique(codes[: len(ids) - step] * len(number) + ids[step:], return_inverse=True)
    often = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """How many lines with a word are equal to an earlier one."""
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


def judge_texts(docs: DataFrame, key: str, text: str, bands: Bands = Bands()) -> DataFrame:
    """``key``, counts of words, characters in them, symbols, repeated lines and words, and the verdict.

    ``ratio`` is NULL for an empty text, ``outside`` the share of bytes in chunks outside their band,
    ``in_bands`` the verdict of the method. Words are what ASCII white space separates. NULL is as
    empty: no words, nothing to judge. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)

        def one(whole: str) -> tuple:
            raw = whole.encode("utf-8", "surrogatepass")
            words = raw.split()
            chars = sum(map(len, words)) if len(raw) == len(whole) else len(b"".join(words).decode("utf-8", "surrogatepass"))
            view = memoryview(raw)
            parts = [view, *(view[a : a + bands.chunk] for a in range(0, len(raw), bands.chunk))] if raw else []
            verdict = bands.judge(raw, [len(press.compress(part)) for part in parts])
            symbols = sum(map(whole.count, SYMBOLS))
            return len(words), chars, symbols, repeated_lines(whole), repeated_words(words), *verdict

        return lambda columns: [columns[0], *map(list, zip(*map(one, columns[1])))]

    kind = dict(rows.dtypes)["key"]
    out = (
        f"key {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "ratio double, outside double, in_bands boolean"
    )
    found = map_arrow(rows, out, start)
    return found.select(F.col("key").alias(key), *found.columns[1:])
