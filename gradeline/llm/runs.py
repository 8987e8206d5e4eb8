"""Periodic runs of words: suffix trees of a text and its reversal give constant-time LCE.

A run has a Lyndon root that is the longest Lyndon word at its first place under one of the two
orders of words, so twice as many candidates as words hold every run. The common extensions of a
candidate to the right and to the left are depths of lowest common ancestors in the two trees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import map_arrow

#: Places of a tour that make a block of the range minimum, and queries answered at once.
BLOCK, QUERIES = 32, 1 << 15
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _grow(symbols: list[int]) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """Ukkonen's suffix tree: first place, end (-1: open) and link of each node's edge, and the children.

    ``symbols`` end with one that is nowhere else. Node 0 is the root; a child hangs at node * width + symbol.
    """
    width = max(symbols) + 1
    first, end, link, child = [0], [0], [0], {}
    node, edge, length, waiting = 0, 0, 0, 0
    for place, symbol in enumerate(symbols):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                edge = place
            key = node * width + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(place), end.append(-1), link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                size = (place + 1 if end[below] < 0 else end[below]) - first[below]
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                if symbols[first[below] + length] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                split, cut = len(first), first[below] + length
                first.append(first[below]), end.append(cut), link.append(0)
                child[key] = split
                child[split * width + symbol] = split + 1
                first.append(place), end.append(-1), link.append(0)
                first[below] = cut
                child[split * width + symbols[cut]] = below
                if fresh:
                    link[fresh] = split
                fresh = split
            waiting -= 1
            if not node and length:
                length -= 1
                edge = place - waiting + 1
            elif node:
                node = link[node]
    return first, end, link, child


class Tree:
    """The suffix tree of ``words`` (numbers from 1): order of its suffixes, and longest common prefixes."""

    def __init__(self, words: np.ndarray):
        symbols = words.tolist() + [0]
        self.size = len(symbols)
        first, end, _, child = _grow(symbols)
        width = max(symbols) + 1
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.nodes, self.parents, self.starts = nodes[order], keys[order] // width, keys[order] % width
        self.edges = np.searchsorted(self.parents, np.arange(len(first) + 1))
        ends = np.array(end)
        ends[ends < 0] = self.size
        self.lengths = ends - np.array(first)
        self._tour()

    def _tour(self) -> None:
        """Depths along the Euler tour, where each suffix is met, and the tables of its range minima."""
        nodes, edges, lengths = self.nodes.tolist(), self.edges.tolist(), self.lengths.tolist()
        depths, met, path = [0], [0] * self.size, [(0, edges[0], edges[1])]
        while path:
            depth, at, last = path.pop()
            if at == last:
                if path:
                    depths.append(path[-1][0])
                continue
            path.append((depth, at + 1, last))
            node = nodes[at]
            down = depth + lengths[node]
            if edges[node] == edges[node + 1]:
                met[self.size - down] = len(depths)
                depths.append(down)
                depths.append(depth)
            else:
                depths.append(down)
                path.append((down, edges[node], edges[node + 1]))
        self.met = np.array(met)
        held = np.full(-(-len(depths) // BLOCK) * BLOCK, self.size, dtype=np.int32)
        held[: len(depths)] = depths
        self.blocks = held.reshape(-1, BLOCK)
        self.left = np.minimum.accumulate(self.blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(self.blocks):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def ranks(self, falling: bool) -> np.ndarray:
        """The rank of each suffix, words in rising or ``falling`` order; the end comes before all words."""
        if not falling:
            return np.argsort(np.argsort(self.met))
        order = np.lexsort((np.where(self.starts == 0, -self.size, -self.starts), self.parents))
        nodes, edges, lengths = self.nodes[order].tolist(), self.edges.tolist(), self.lengths.tolist()
        ranks, met, path = np.zeros(self.size, dtype=np.int64), [], [(0, 0)]
        while path:
            node, depth = path.pop()
            if edges[node] == edges[node + 1]:
                met.append(self.size - depth)
            else:
                path.extend((below, depth + lengths[below]) for below in nodes[edges[node] : edges[node + 1]][::-1])
        ranks[met] = np.arange(len(met))
        return ranks

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, which differ."""
        parts = [self._common(a[i : i + QUERIES], b[i : i + QUERIES]) for i in range(0, len(a), QUERIES)]
        return np.concatenate([np.zeros(0, dtype=np.int64), *parts])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.met[a], self.met[b]), np.maximum(self.met[a], self.met[b])
        from_block, to_block = low // BLOCK, high // BLOCK
        least = np.minimum(self.right[low], self.left[high])
        between = to_block - from_block - 1
        for level in range(len(self.levels)):
            some = np.flatnonzero((between >> level == 1) & (between > 0))
            if some.size:
                table, step = self.levels[level], 1 << level
                inner = np.minimum(table[from_block[some] + 1], table[to_block[some] - step])
                least[some] = np.minimum(least[some], inner)
        same = np.flatnonzero(between < 0)
        if same.size:
            places = np.arange(BLOCK)
            inside = (places >= (low[same] % BLOCK)[:, None]) & (places <= (high[same] % BLOCK)[:, None])
            least[same] = np.where(inside, self.blocks[from_block[same]], self.size).min(axis=1)
        return least.astype(np.int64)


def _next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each suffix the start of the next one of smaller rank: where its longest Lyndon word ends."""
    values, out, open_ = ranks.tolist(), [0] * len(ranks), []
    for place, rank in enumerate(values):
        while open_ and values[open_[-1]] > rank:
            out[open_.pop()] = place
        open_.append(place)
    return np.array(out)


def _tree_runs(words: np.ndarray, least: int, exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, numbers from 1."""
    n = len(words)
    ahead, back = Tree(words), Tree(words[::-1])
    starts, periods = [], []
    for falling in (False, True):
        ends = _next_smaller(ahead.ranks(falling))[:n]
        starts.append(np.arange(n)), periods.append(ends - np.arange(n))
    start, period = np.concatenate(starts), np.concatenate(periods)
    short = period * exponent <= n
    start, period = start[short], period[short]
    right = ahead.common(start, start + period)
    left = np.zeros(len(start), dtype=np.int64)
    inner = start > 0
    left[inner] = back.common(n - start[inner], n - start[inner] - period[inner])
    length = left + period + right
    good = length >= np.maximum(least, exponent * period)
    return set(zip((start - left)[good].tolist(), length[good].tolist(), period[good].tolist()))


def _stretches(words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """(start, end) of the parts that can hold a run: each word of a part is in it ``exponent`` times.

    A run holds each of its words that often, so every run lies inside one part with its neighbours
    of the same period, and words that are rarer cut the text.
    """
    out, open_ = [], [(0, len(words))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        part = words[a:b]
        _, place, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[place] < exponent)
        if not rare.size:
            out.append((a, b))
            continue
        edges = np.concatenate(([-1], rare, [b - a]))
        wide = np.flatnonzero(np.diff(edges) > least)
        open_.extend((a + int(edges[i]) + 1, a + int(edges[i + 1])) for i in wide)
    return out


def word_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, by start, then period.

    A run is a stretch with smallest period q, of at least ``least`` and ``exponent`` * q words,
    that no neighbouring word extends. ``exponent`` is at least 2.
    """
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    runs = []
    for a, b in _stretches(ids, least, exponent):
        _, part = np.unique(ids[a:b], return_inverse=True)
        runs += [(a + start, length, period) for start, length, period in _tree_runs(part + 1, least, exponent)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run contains after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    held = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return words if len(held) == len(words) else [words[i] for i in held.tolist()]


def periodic_runs(
    docs: DataFrame, key: str, text: str, least: int = 6, exponent: int = 4,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``key``, ``runs`` (array of start, length, period) and ``collapsed`` (text) of every row.

    Words are what ASCII white space separates, numbered from 0; ``edit`` may change the words of a
    row by its key first. ``collapsed`` holds the words outside the repetitions, joined by one space.
    NULL, empty and blank texts have no runs and collapse to the empty text. Repeated rows stay; an
    empty table gives no rows. Memory of a task is in proportion to the longest part of one text
    in which every word repeats.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        def one(name: object, whole: str) -> tuple[list[dict], str]:
            words = whole.encode("utf-8", "surrogatepass").split()
            words = edit(name, words) if edit else words
            runs = word_runs(words, least, exponent)
            fields = [dict(zip(("start", "length", "period"), r)) for r in runs]
            return fields, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

        return lambda columns: [columns[0], *map(list, zip(*[one(*r) for r in zip(*columns)]))]

    kind = dict(rows.dtypes)["key"]
    found = map_arrow(rows, f"key {kind}, runs array<{RUN}>, collapsed string", start)
    return found.select(F.col("key").alias(key), "runs", "collapsed")


def repeat_tail(name: object, words: list[bytes]) -> list[bytes]:
    """Repeat the end of one text in ten, chosen by the crc32 of its number; without one, none."""
    from zlib import crc32

    n = len(words)
    if name is None or not n:
        return words
    hashed = crc32(str(name).encode())
    if hashed % 10:
        return words
    other = hashed // 10
    a = other % n
    period = 1 + (n - a) // (3 + other % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * ((n - a) // period + 1))[: n - a]
