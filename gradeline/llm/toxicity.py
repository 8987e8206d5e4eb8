"""Counterfactual-regularised toxicity classifier.

A logistic regression over the words and word starts of a text. Labelled sentences that mention a group get a twin
with another group's term in its place; the difference of their scores is penalised in training, so
a neutral mention of a group does not by itself raise the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import map_arrow

WORD = re.compile(r"[^\W\d_]+")
#: Terms of one list may replace each other in a sentence. English defaults; the lists are a parameter.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
)


STEMS = (4, 5, 6)


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(found: set[str]) -> set[str]:
    """The words, and the starts of the longer ones, which languages with endings need."""
    return found.union(w[:n] + "-" for w in found if len(w) > STEMS[0] for n in STEMS if n < len(w))


def swapped(found: set[str], terms: tuple[tuple[str, ...], ...], rng: np.random.Generator) -> set[str] | None:
    """The words with every identity term replaced by another of its list; None if there is none."""
    out = set(found)
    for group in terms:
        for term in found.intersection(group):
            others = [t for t in group if t != term]
            out.discard(term)
            out.add(others[int(rng.integers(len(others)))])
    return out if out != found else None


class Classifier:
    """Weights of the chosen words and a bias."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self._keys = frozenset(vocabulary)

    @classmethod
    def fit(
        cls, texts: list[str], labels: list[int], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
        most: int = 500, least: float = 2.5, twin_penalty: float = 5.0, penalty: float = 1.0, rounds: int = 400, seed: int = 11,
    ) -> Classifier:
        """Least log loss plus ``twin_penalty`` times the squared score change of each swap.

        Each text that holds an identity term has a twin with the terms swapped. As groups are
        seldom named, every text also gets a neutral mention of a random group added, and its twin
        another one. Words are chosen by how much their rate differs between the labels: at least
        ``least`` standard errors, and the ``most`` clearest. Both labels weigh the same. With fewer than two labels the score is the share of label 1 (0.5 if
        nothing is labelled).
        """
        y = np.array(labels, dtype=float)
        if not len(y) or y.min() == y.max():
            share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return cls({}, np.zeros(0), float(np.log(share / (1 - share))))
        found = [words(t) for t in texts]
        rate = [Counter(), Counter()]
        for f, label in zip(found, labels):
            rate[label].update(features(f))
        n = [(y == 0).sum(), (y == 1).sum()]
        named = sorted({t for group in terms for t in group})

        def contrast(w: str) -> float:
            p, q = rate[1][w] / n[1], rate[0][w] / n[0]
            spread = p * (1 - p) / n[1] + q * (1 - q) / n[0] + 1 / n[1] ** 2 + 1 / n[0] ** 2
            return abs(p - q) / spread**0.5

        clear = {w: z for w in rate[0].keys() | rate[1].keys() if (z := contrast(w)) >= least}
        ranked = sorted(clear, key=lambda w: (-clear[w], w))[:most]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*ranked, *named]))}

        def matrix(rows: list[set[str]]) -> np.ndarray:
            out = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
            for i, row in enumerate(rows):
                out[i, [vocabulary[w] for w in features(row).intersection(vocabulary)]] = 1
            return out

        rng = np.random.default_rng(seed)
        left, right = [], []
        for f in found:
            mention = f | {named[int(rng.integers(len(named)))]} if named else f
            for row in (f, mention):
                twin = swapped(row, terms, rng)
                if twin is not None:
                    left.append(row)
                    right.append(twin)
        x = matrix(found)
        weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
        pairs = (matrix(left), matrix(right)) if left else None
        w, b = np.zeros(x.shape[1]), 0.0
        moment, square = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        for t in range(1, rounds + 1):  # Adam on the whole sample
            error = weight * (_sigmoid(x @ w + b) - y)
            slope, slope_b = x.T @ error + penalty * w / len(y), error.sum()
            if pairs:
                p, q = _sigmoid(pairs[0] @ w + b), _sigmoid(pairs[1] @ w + b)
                pull = 2 * twin_penalty * (p - q) / len(p)
                slope += pairs[0].T @ (pull * p * (1 - p)) - pairs[1].T @ (pull * q * (1 - q))
                slope_b += (pull * (p * (1 - p) - q * (1 - q))).sum()
            step = np.append(slope, slope_b)
            moment = 0.9 * moment + 0.1 * step
            square = 0.99 * square + 0.01 * step**2
            move = 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return cls(vocabulary, w, float(b))

    def score(self, text: str | None) -> float:
        """Chance of label 1 of the whole text; an empty text has that of no words."""
        held = self._keys.intersection(features(words(text or "")))
        total = self.bias + sum(self.weights[self.vocabulary[w]] for w in sorted(held))
        return float(_sigmoid(np.float64(total)))


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def learn(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
) -> Classifier:
    """Fit on at most ``per_label`` labelled texts of each label (0, 1), those with the smallest hashes.

    Labels other than 0 and 1, NULL keys and NULL texts are not learned from; a key labelled several
    times counts with its largest label. The chosen keys are few, so they are broadcast to the texts.
    """
    given = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    given = given.where("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    given = given.withColumn("hash", F.xxhash64("key"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    known = given.join(rows.select("key").distinct(), "key", "left_semi")
    picked = [known.where(F.col("label") == v).orderBy("hash", "key").limit(per_label) for v in (0, 1)]
    chosen = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "key").groupBy("key").agg(
        F.max("label").alias("label"), F.max("text").alias("text")
    )
    found = sorted((r.key, r.label, r.text) for r in chosen.collect())
    return Classifier.fit([t for _, _, t in found], [v for _, v, _ in found], terms)


def score(docs: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row's whole text.

    NULL and empty texts get the score of a text without words. Repeated rows and NULL keys stay;
    no other column is read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def start():
        return lambda columns: [columns[0], [model.score(t) for t in columns[1]]]

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, score double", start).withColumnRenamed("key", key)
