"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over character n-grams says
which side of the bit a text is on. Decoding sums each classifier's logistic loss against the bits of
a codeword and takes the codeword with the least loss; a narrow lead marks the text ambiguous.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gradeline.llm.common import map_arrow

#: No language: NULL, empty, or no letter.
UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 11
BUCKETS = 1 << BITS
#: Whether a code point is a letter, for those below the table's end.
LETTER = np.array([chr(c).isalpha() for c in range(0x2000)])
#: Code points of a text that are counted at once; longer texts go through in pieces.
PIECE = 1 << 20
SPACE = np.array([32], dtype=np.uint32)
MIX, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Up to this many languages every two-way split of them is a bit.
EXHAUSTIVE = 5
#: Parts of a language's hashes that are cut to the wanted number each before they meet.
PARTS = 64


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 per class; columns all differ, also up to sign, and none is constant.

    All 2^(n-1) - 1 splits for few classes, else random ones, 10 log2(n) bits, spread out by taking
    the best of several draws.
    """
    if classes < 2:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (classes - 1))
        return (1 - 2 * ((splits >> np.arange(classes)[:, None]) & 1)).astype(np.int8)
    bits, rng, best, apart = int(np.ceil(10 * np.log2(classes))), np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(classes, bits))
        distance = (code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(classes, dtype=int)
        varied = (np.abs(code.sum(axis=0)) < classes).all()
        if varied and distance.min() > apart:
            best, apart = code, distance.min()
    return best


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Shares of hashed character n-grams of the whole lower-cased text, per order; float32.

    Whatever is not a letter counts as a space, and spaces as one, so digits and marks carry nothing.
    """
    counts = np.zeros(len(ORDERS) * BUCKETS)
    low = text.lower()
    for a in range(0, len(low), PIECE):
        code = np.frombuffer(low[a : a + PIECE].encode("utf-32-le", "replace"), dtype="<u4")
        far = np.flatnonzero(code >= len(LETTER))
        letter = LETTER[np.minimum(code, len(LETTER) - 1)]
        if len(far):
            kinds = {c: chr(c).isalpha() for c in np.unique(code[far]).tolist()}
            letter[far] = [kinds[c] for c in code[far].tolist()]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # the first of a run of other characters stands for a space
        code = np.where(letter, code, np.uint32(32))[kept]
        code = np.concatenate((SPACE, code, SPACE))
        mixed = np.zeros(len(code), dtype=np.uint32)
        for i, order in enumerate(ORDERS):
            n = len(code) - order + 1
            mixed = mixed[:n] * MIX + code[order - 1 :]
            at = (mixed * SPREAD) >> np.uint32(32 - BITS)
            counts[i * BUCKETS : (i + 1) * BUCKETS] += np.bincount(at, minlength=BUCKETS)
    shares = counts.reshape(len(ORDERS), BUCKETS)
    return np.sqrt(shares / np.maximum(1, shares.sum(axis=1, keepdims=True))).ravel().astype(np.float32)


class Codes:
    """Codewords of the learned languages and a linear classifier per bit."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.code = codewords(len(languages)).astype(np.float32)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], rounds: int = 150, penalty: float = 1e-3) -> Codes:
        """Logistic regression per bit, all bits at once, by accelerated gradient steps.

        Classes weigh the same however many texts they have.
        """
        languages = sorted(set(labels))
        code = codewords(len(languages)).astype(np.float32)
        if not languages:
            return cls([], np.zeros((len(ORDERS) * BUCKETS, 1), np.float32), np.zeros(1, np.float32))
        x = np.stack([profile(t) for t in texts])
        y = np.array([languages.index(label) for label in labels])
        target = code[y]
        weight = (1.0 / np.bincount(y, minlength=len(languages)))[y, None].astype(np.float32) / len(languages)
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        seen_w, seen_b, rate = w, b, np.float32(1.2)  # rows have norm sqrt(3), so 4/3 bounds the rate
        for t in range(rounds):
            slope = -target * weight / (1 + np.exp(np.clip(target * (x @ seen_w + seen_b), -30, 30)))
            new_w = seen_w - rate * (x.T @ slope + penalty * seen_w / len(languages))
            new_b = seen_b - rate * slope.sum(axis=0)
            push = t / (t + 3)
            seen_w, seen_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
            w, b = new_w, new_b
        return cls(languages, w, b)

    def losses(self, text: str) -> np.ndarray:
        """Mean logistic loss of the bit scores against each codeword."""
        margin = (profile(text) @ self.weights + self.bias)[None, :] * self.code
        return np.log1p(np.exp(-np.clip(margin, -30, 30))).mean(axis=1)

    def predict(self, text: str | None, lead: float) -> tuple[str, float, bool]:
        """(language, score, ambiguous); score is the softmax of the negative losses, summed per bit."""
        if text is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, False
        loss = self.losses(text) * self.code.shape[1]
        chance = np.exp(loss.min() - loss)
        chance /= chance.sum()
        best = int(np.argmin(loss))
        rest = np.partition(chance, -2)[-2] if len(chance) > 1 else 0.0
        return self.languages[best], float(chance[best]), bool(chance[best] - rest < lead)


def learn(labelled: DataFrame, text: str, lang: str, per_language: int) -> Codes:
    """Fit on at most ``per_language`` texts of each language, those with the smallest hashes.

    Rows with a NULL label or a text without content are not learned from; ``und`` is no language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (F.length(F.trim("text")) > 0))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    picked = rows.select("lang", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # of a language that most rows have, parts go on, each cut already
        first = Window.partitionBy(*keys).orderBy("hash")
        picked = picked.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language)
    picked = picked.select("lang", "hash")
    chosen = rows.join(F.broadcast(picked), ["lang", "hash"]).dropDuplicates(["lang", "hash"])  # per_language rows each
    found = sorted((r.lang, r.text) for r in chosen.select("lang", "text").collect() if has_letter(r.text))
    return Codes.fit([t for _, t in found], [label for label, _ in found])


def identify(docs: DataFrame, key: str, text: str, model: Codes, lead: float = 0.1) -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every row's whole text.

    ``ambiguous`` marks a lead over the second language below ``lead``. NULL, empty and letterless
    texts are ``und`` with score 0 and ambiguous. If nothing was learned all texts are ``und``, those
    with letters not ambiguous. Repeated rows
    and NULL keys stay; no other column is read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def start():
        def step(columns):
            found = [model.predict(t, lead) for t in columns[1]]
            return [columns[0], *([f[i] for f in found] for i in range(3))]

        return step

    kind = dict(rows.dtypes)["key"]
    out = map_arrow(rows, f"key {kind}, lang_pred string, score double, ambiguous boolean", start)
    return out.withColumnRenamed("key", key)


def recognised(docs: DataFrame, text: str, model: Codes, lead: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is not ambiguous. All columns stay."""

    def sure(texts: pd.Series) -> pd.Series:
        found = (model.predict(t if isinstance(t, str) else None, lead) for t in texts)
        return pd.Series([not ambiguous for _, _, ambiguous in found], dtype=bool)

    return docs.where(F.pandas_udf(sure, "boolean")(F.col(text)))
