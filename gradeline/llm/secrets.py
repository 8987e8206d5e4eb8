"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers. Runs of token characters that
the patterns did not take are scored by the mean log-likelihood ratio per transition.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import map_arrow, sample_texts

#: Kinds in the order in which equal starts are listed; "random" is the models' own.
KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"

# The base patterns.
ASSIGN = re.compile(
    r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: What a candidate of the models is made of, and how short it may be.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]{5,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
WIDTH = len(ALPHABET) + 2  # one for all else, one for the start
#: Times that the models are fitted at most.
REFITS = 10


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, in kind order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]  # greedy: whole runs
    return found


def in_order(spans: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All strings' codes, each after a start mark, and for each code its string."""
    raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(raw < 128, _CODE[np.minimum(raw, 127)], len(ALPHABET))
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    owner = np.repeat(np.arange(len(strings)), sizes)
    out = np.full(len(code) + len(strings), WIDTH - 1, dtype=np.int64)
    out[np.arange(len(code)) + owner + 1] = code
    return out, np.repeat(np.arange(len(strings)), sizes + 1)


class Ratio:
    """log P(next | current) of the random model less that of the identifier model, and a threshold."""

    def __init__(self, random: list[str], ordinary: list[str], smooth: float = 0.5, margin: float = 0.3):
        """Fit both models by smoothed transition counts.

        Ordinary samples that score as random, closer to the random samples' middle than to the
        ordinary ones', are unlabelled tokens: both models are fitted again without them, until none
        is left. ``margin`` places the threshold between the 0.999 quantile of the ordinary scores
        and the lowest of the random samples' middle 98 %. With no sample of either kind nothing is
        ever flagged.
        """
        self.threshold = float("inf")
        for _ in range(REFITS):
            self.table = self._log(random, smooth) - self._log(ordinary, smooth)
            if not (random and ordinary):
                return
            scores, drawn = self.scores(ordinary), self.scores(random)
            middle = (np.median(scores) + np.median(drawn)) / 2
            clean = [w for w, score in zip(ordinary, scores.tolist()) if score <= middle]
            if len(clean) == len(ordinary):
                break
            ordinary = clean
        low, high = np.quantile(self.scores(random), 0.01), np.quantile(self.scores(ordinary), 0.999)
        self.threshold = float(high + margin * (low - high)) if low > high else float(high)

    @staticmethod
    def _log(strings: list[str], smooth: float) -> np.ndarray:
        counts = np.full((WIDTH, WIDTH), smooth)
        if strings:
            code, owner = _codes(strings)
            same = owner[1:] == owner[:-1]
            np.add.at(counts, (code[:-1][same], code[1:][same]), 1)
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    def scores(self, strings: list[str]) -> np.ndarray:
        """Mean log-likelihood ratio per character; 0 for the empty string."""
        if not strings:
            return np.zeros(0)
        code, owner = _codes(strings)
        same = owner[1:] == owner[:-1]
        total = np.bincount(owner[1:][same], self.table[code[:-1][same], code[1:][same]], minlength=len(strings))
        return total / np.maximum(1, [len(s) for s in strings])


def scan(texts: list[str], model: Ratio) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: the base ones, and candidates over the threshold that touch none."""
    base = [base_spans(t) for t in texts]
    free, strings = [], []
    for i, (t, taken) in enumerate(zip(texts, base)):
        for m in CANDIDATE.finditer(t):
            if not m[0].strip("0123456789+/_=-"):
                continue  # without a letter it is a number or a rule
            if not any(a < m.end() and m.start() < b for _, a, b in taken):
                free.append((i, m.start(), m.end()))
                strings.append(m[0])
    for (i, a, b), score in zip(free, model.scores(strings).tolist()):
        if score > model.threshold:
            base[i].append(("random", a, b))
    return [in_order(spans) for spans in base]


def samples(docs: DataFrame, text: str, per_label: int) -> tuple[list[str], list[str]]:
    """Labelled strings from at most ``per_label`` texts of each label: (random, ordinary).

    A base pattern labels its value random; an identifier outside all spans is ordinary, the four
    longest of a text. The texts with the smallest hashes are taken, so the choice hangs neither on
    layout nor on order; random strings come from the texts that hold what a base pattern needs.
    """
    marked = F.col(text).rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[:=]")
    picked = [sample_texts(docs, text, rule, per_label) for rule in (marked, F.lit(True))]

    def start():
        def step(columns):
            values, kinds = [], []
            for t in columns[0]:
                spans = base_spans(t)
                chosen = {(t[a:b], "random") for kind, a, b in spans if kind != "assign"}
                chosen |= {(m[1], "random") for m in ASSIGN.finditer(t) if len(m[1]) >= 12}
                names = {m[0] for m in WORD.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
                chosen |= {(w, "ordinary") for w in sorted(names, key=lambda w: (-len(w), w))[:4]}
                values += [v for v, _ in chosen]
                kinds += [k for _, k in chosen]
            return [values, kinds]

        return step

    found = map_arrow(picked[0].unionByName(picked[1]), "value string, label string", start).distinct()
    rows = found.orderBy("label", "value").collect()
    return [r.value for r in rows if r.label == "random"], [r.value for r in rows if r.label == "ordinary"]


def find_secrets(docs: DataFrame, key: str, text: str, model: Ratio) -> DataFrame:
    """``key``, ``spans`` (kind, start, end in code points) of every row's whole text.

    Sorted by start, then kind. NULL and empty texts have no spans; repeated rows and NULL keys
    stay; no other column is read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        def step(columns):
            found = scan(columns[1], model)
            return [columns[0], [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]]

        return step

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, spans {SPANS}", start).select(F.col("key").alias(key), "spans")
