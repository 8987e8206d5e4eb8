"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions trained in numpy.

A text is read in overlapping windows. The windows' tag scores are averaged where they overlap, and
one Viterbi pass over each covered stretch of the text decides all tags together. Every span holds a
digit or an at sign, so a window without one nearby has no span to find and is not scored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gradeline.llm.common import free_name, map_arrow, sample_texts

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

ANCHOR = re.compile(r"[0-9@]+")
WINDOW, STRIDE, MARGIN = 64, 32, 24
TAGS = 1 + 2 * len(KINDS)  # none, then first and further character of each kind


def digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(number: str) -> bool:
    doubled = [int(c) for c in reversed(number)]
    doubled[1::2] = [d * 2 - 9 * (d > 4) for d in doubled[1::2]]
    return sum(doubled) % 10 == 0


def base_spans(text: str, checked: bool = True) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping per kind, in kind order.

    ``checked`` drops card numbers that fail their check digit. An address starts where the run of its local characters does, so each at sign is looked at
    once, whatever the length of the run.
    """
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in LOCAL_SET:
                start -= 1
            if start < at:
                found.append(("email", start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if not ANCHOR.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(number := digits(m[0])) <= 19 and (luhn(number) or not checked):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return found


def in_order(spans: list[tuple]) -> list[tuple]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_MARKS = "@.-+()_%:/=\"',; \n#[]{}<>!?*&$|\\~^"
CLASSES = 1 + 26 + 1 + 1 + len(_MARKS) + 1  # padding, a-z, A-Z, 0-9, marks, all else
_CLASS = np.full(128, CLASSES - 1, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = np.arange(1, 27), 27, 28
_CLASS[[ord(c) for c in _MARKS]] = 29 + np.arange(len(_MARKS))


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], CLASSES - 1)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around its digits and at signs, merged, on the window grid."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a = max(0, (m.start() - MARGIN) // STRIDE * STRIDE)
        b = min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _logsum(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))


class Tagger:
    """Two LSTMs over character classes, a linear layer, and CRF transitions."""

    def __init__(self, hidden: int = 12, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.hidden = h
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["h" + side] = rng.normal(0, 0.3, (h, 4 * h))
            self.p["c" + side] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["ob"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))  # from, to
        #: What no tagging may do: go on with a kind that was not begun.
        self.barred = np.zeros((TAGS, TAGS))
        for i in range(len(KINDS)):
            self.barred[:, 2 + 2 * i] = -1e4
            self.barred[[1 + 2 * i, 2 + 2 * i], 2 + 2 * i] = 0
        self.first = np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0.0)

    def _lstm(self, codes: np.ndarray, side: str, keep: bool):
        """Hidden states (batch, time, hidden), and what the backward pass needs."""
        n, steps, h = *codes.shape, self.hidden
        inputs = self.p["x" + side][codes] + self.p["c" + side]
        state, cell, out, log = np.zeros((n, h)), np.zeros((n, h)), np.empty((n, steps, h)), []
        for t in range(steps):
            z = inputs[:, t] + state @ self.p["h" + side]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            old, old_state = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            if keep:
                log.append((i, f, o, g, old, old_state, squashed))
        return out, log

    def emissions(self, codes: np.ndarray, keep: bool = False):
        ahead, log_f = self._lstm(codes, "f", keep)
        back, log_b = self._lstm(codes[:, ::-1], "b", keep)
        both = np.concatenate([ahead, back[:, ::-1]], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, log_f, log_b

    def _lstm_grad(self, codes, side, log, up, grad):
        n, steps, h = *codes.shape, self.hidden
        d_state, d_cell, d_inputs = np.zeros((n, h)), np.zeros((n, h)), np.empty((n, steps, 4 * h))
        for t in range(steps - 1, -1, -1):
            i, f, o, g, old, old_state, squashed = log[t]
            d_state = d_state + up[:, t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            z = np.concatenate([
                d_cell * g * i * (1 - i), d_cell * old * f * (1 - f),
                d_state * squashed * o * (1 - o), d_cell * i * (1 - g**2),
            ], axis=1)
            d_inputs[:, t] = z
            grad["h" + side] += old_state.T @ z
            d_state, d_cell = z @ self.p["h" + side].T, d_cell * f
        grad["c" + side] += d_inputs.sum(axis=(0, 1))
        np.add.at(grad["x" + side], codes, d_inputs)

    def loss_and_grad(self, codes: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags per window, and its gradient."""
        n, steps = codes.shape
        emit, both, log_f, log_b = self.emissions(codes, keep=True)
        move = self.p["t"] + self.barred
        ahead = np.empty((n, steps, TAGS))
        ahead[:, 0] = self.first + emit[:, 0]
        for t in range(1, steps):
            ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + move, 1) + emit[:, t]
        total = _logsum(ahead[:, -1], 1)
        back = np.zeros((n, TAGS))
        d_emit, grad = np.empty_like(emit), {k: np.zeros_like(v) for k, v in self.p.items()}
        d_emit[:, -1] = np.exp(ahead[:, -1] - total[:, None])
        for t in range(steps - 2, -1, -1):
            later = emit[:, t + 1] + back
            pair = np.exp(ahead[:, t][:, :, None] + move + later[:, None, :] - total[:, None, None])
            grad["t"] += pair.sum(axis=0)
            d_emit[:, t] = pair.sum(axis=2)
            back = _logsum(move + later[:, None, :], 2)
        rows = np.arange(n)
        gold = self.first[tags[:, 0]] + emit[rows, 0, tags[:, 0]]
        for t in range(1, steps):
            gold = gold + move[tags[:, t - 1], tags[:, t]] + emit[rows, t, tags[:, t]]
            np.add.at(grad["t"], (tags[:, t - 1], tags[:, t]), -1)
        d_emit[rows[:, None], np.arange(steps), tags] -= 1
        flat = d_emit.reshape(-1, TAGS)
        grad["o"] += both.reshape(len(flat), -1).T @ flat
        grad["ob"] += flat.sum(axis=0)
        up = d_emit @ self.p["o"].T
        self._lstm_grad(codes, "f", log_f, up[:, :, : self.hidden], grad)
        self._lstm_grad(codes[:, ::-1], "b", log_b, up[:, ::-1, self.hidden :], grad)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 5):
        """Adam over shuffled batches; the rate falls to a tenth. Nothing to learn from changes nothing."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        steps = max(1, epochs * -(-len(codes) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for a in range(0, len(order), batch):
                step += 1
                _, grad = self.loss_and_grad(codes[order[a : a + batch]], tags[order[a : a + batch]])
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each score table (time, tags), tables of like length at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(emits)
        order = sorted(range(len(emits)), key=lambda i: len(emits[i]))
        move = self.p["t"] + self.barred
        while order:
            least = max(64, len(emits[order[-1]]) // 2)  # none is padded to over twice its length
            group = [i for i in order[-256:] if len(emits[i]) >= least] or order[-1:]
            order = order[: -len(group)]
            longest = max(len(emits[i]) for i in group)
            if not longest:
                continue
            table = np.zeros((len(group), longest, TAGS))
            for row, i in enumerate(group):
                table[row, : len(emits[i])] = emits[i]
            sizes = np.array([len(emits[i]) for i in group])
            best, came = self.first + table[:, 0], np.zeros((longest, len(group), TAGS), dtype=np.int8)
            for t in range(1, longest):
                scores = best[:, :, None] + move
                came[t] = scores.argmax(axis=1)
                alive = (t < sizes)[:, None]
                came[t] = np.where(alive, came[t], np.arange(TAGS))
                best = np.where(alive, scores.max(axis=1) + table[:, t], best)
            tag, path = best.argmax(axis=1), np.empty((len(group), longest), dtype=int)
            for t in range(longest - 1, -1, -1):
                path[:, t] = tag
                tag = came[t][np.arange(len(group)), tag]
            for row, i in enumerate(group):
                out[i] = path[row, : len(emits[i])]
        return out

    def tag(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each whole text, from all its windows."""
        parts = [(n, a, b) for n, t in enumerate(texts) for a, b in stretches(t)]
        spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        coded = {n: classes(texts[n]) for n in {n for n, _, _ in parts}}
        places = [(k, s) for k, (n, a, b) in enumerate(parts) for s in range(a, max(a + 1, b - STRIDE), STRIDE)]
        middle = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(float)[:, None]
        scores = [np.zeros((b - a, TAGS)) for _, a, b in parts]
        weight = [np.zeros((b - a, 1)) for _, a, b in parts]
        for at in range(0, len(places), 512):
            chosen = places[at : at + 512]
            codes = np.zeros((len(chosen), WINDOW), dtype=np.int64)
            for row, (k, s) in enumerate(chosen):
                piece = coded[parts[k][0]][s : s + WINDOW]
                codes[row, : len(piece)] = piece
            emit = self.emissions(codes)[0]
            for row, (k, s) in enumerate(chosen):
                _, a, b = parts[k]
                end = min(s + WINDOW, b)
                scores[k][s - a : end - a] += (emit[row] * middle)[: end - s]
                weight[k][s - a : end - a] += middle[: end - s]
        paths = self.decode([s / w for s, w in zip(scores, weight)])
        for (n, a, _), path in zip(parts, paths):
            starts = np.flatnonzero(path % 2 == 1)
            for i in starts.tolist():
                inside, end = path[i] + 1, i + 1
                while end < len(path) and path[end] == inside:
                    end += 1
                spans[n].append(trimmed(texts[n], KINDS[path[i] // 2], a + i, a + end))
        return spans


def trimmed(text: str, kind: str, a: int, b: int) -> tuple[str, int, int]:
    """The span without what its kind cannot begin or end with; it may be left empty."""
    if kind == "email":
        at = text.find("@", a, b)
        a = max([a, *(m.end() + a for m in re.finditer(r"\s", text[a : max(a, at)]))])
        b = min([b, *(m.start() + at for m in re.finditer(r"\s", text[at:b]))]) if at >= 0 else a
    while a < b and not (text[a].isalnum() if kind == "email" else text[a] in "0123456789+("):
        a += 1
    while a < b and not (text[b - 1].isalnum() if kind == "email" else text[b - 1] in "0123456789"):
        b -= 1
    return kind, a, b


def plausible(kind: str, found: str) -> bool:
    """Whether a tagged span can be what it is tagged as: the checks of its kind, not its pattern."""
    n = len(digits(found))
    if kind == "email":
        return 0 < found.find("@") < len(found) - 1
    if kind == "ip":
        return len(parts := re.findall("[0-9]+", found)) == 4 and all(int(p[-4:]) <= 255 and len(p) <= 3 for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits(found))
    return 7 <= n <= 15


def scan(texts: list[str], model: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text: base ones, then plausible tagged ones that touch none of them."""
    out = []
    tagged = model.tag(texts) if model else [[] for _ in texts]
    for t, found in zip(texts, tagged):
        base = [(*s, True) for s in base_spans(t)]
        taken = [(a, b) for _, a, b, _ in base]
        for kind, a, b in found:
            if plausible(kind, t[a:b]) and not any(x < b and a < y for x, y in taken):
                base.append((kind, a, b, False))
        out.append(in_order(base))
    return out


def windows(texts: list[str], spans: list[list[tuple[str, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows (classes, tags) on the grid around every digit and at sign of the texts."""
    codes, tags = [], []
    for t, found in zip(texts, spans):
        c, y = classes(t), np.zeros(len(t), dtype=np.int64)
        for kind, a, b in reversed(in_order(found)):
            y[a:b] = 2 + 2 * KINDS.index(kind)
            y[a] -= 1
        after = y[1:]
        broken = (after % 2 == 0) & (after > 0) & (y[:-1] != after) & (y[:-1] != after - 1)
        after[broken] -= 1  # what is left of a span behind one that overlaps it begins anew
        for a, b in stretches(t):
            for s in range(a, max(a + 1, b - STRIDE), STRIDE):
                row, lab = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW, dtype=np.int64)
                row[: len(c[s : s + WINDOW])] = c[s : s + WINDOW]
                lab[: len(y[s : s + WINDOW])] = y[s : s + WINDOW]
                if lab[0] and lab[0] % 2 == 0:
                    lab[0] -= 1  # a span that the window cuts
                codes.append(row)
                tags.append(lab)
    if not codes:
        return np.zeros((0, WINDOW), dtype=np.int64), np.zeros((0, WINDOW), dtype=np.int64)
    return np.stack(codes), np.stack(tags)


def varied(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with some spans written another way: a phone without its plus, a grouped card."""
    out, moved, at = [], [], 0
    size = 0
    for kind, a, b in in_order(spans):
        if a < at:
            continue
        new = text[a:b]
        if kind == "phone" and rng.random() < 0.5:
            new = new.lstrip("+")
        elif kind == "card" and rng.random() < 0.5:
            number, gap = digits(new), "- "[int(rng.integers(2))]
            new = gap.join(number[i : i + 4] for i in range(0, len(number), 4))
        out += [text[at:a], new]
        size += a - at
        moved.append((kind, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), moved


def learn(docs: DataFrame, text: str, sample: int, most_windows: int = 2500, seed: int = 5) -> Tagger | None:
    """Train on spans that the base patterns label in at most ``sample`` texts with digits or at signs.

    The texts with the smallest hashes are taken, each once as it is and once ``varied``; of their
    windows at most ``most_windows``, evenly. None if no text has a span.
    """
    texts = sorted(r.text for r in sample_texts(docs, text, F.col(text).rlike("[0-9@]"), sample).collect())
    rng = np.random.default_rng(seed)
    plain = [(t, base_spans(t, checked=False)) for t in texts]  # a tagger sees the form, not the check digit
    every = plain + [varied(t, s, rng) for t, s in plain if s]
    if not any(s for _, s in every):
        return None
    codes, tags = windows([t for t, _ in every], [s for _, s in every])
    chosen = rng.permutation(len(codes))[:most_windows]
    return Tagger(seed=seed).fit(codes[chosen], tags[chosen])


def find_personal(docs: DataFrame, key: str, text: str, model: Tagger | None) -> DataFrame:
    """``key``, ``spans`` (kind, start, end in code points, base) of every row's whole text.

    Sorted by start, then kind; ``base`` tells pattern spans from the model's. NULL and empty texts
    have none; repeated rows and NULL keys stay; no other column is read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        def step(columns):
            names = ("kind", "start", "end", "base")
            return [columns[0], [[dict(zip(names, s)) for s in spans] for spans in scan(columns[1], model)]]

        return step

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, spans {SPANS}", start).select(F.col("key").alias(key), "spans")


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at, end = [], 0, 0
    for kind, a, b, *_ in spans:
        if a >= end:
            out += [text[at:a] if a > at else "", f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str, model: Tagger | None, counted: str | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with personal data in ``text`` masked.

    A NULL text stays NULL; texts without spans stay as they are. ``counted`` names a column that
    is set to the new text's length where a span was masked. Other columns go through untouched.
    """

    def change(texts: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(texts), 256):  # bounded slices
            part = texts.iloc[a : a + 256].tolist()
            found = scan([t if isinstance(t, str) else "" for t in part], model)
            out += [masked(t, spans) if spans else t for t, spans in zip(part, found)]
        return pd.Series(out, index=texts.index, dtype=object)

    made = free_name(docs, "_pii_text")
    out = docs.withColumn(made, F.pandas_udf(change, "string")(F.col(text)))
    new = {text: F.col(made)}
    if counted and counted in docs.columns:
        length = F.length(made).cast(dict(docs.dtypes)[counted])
        new[counted] = F.when(~F.col(text).eqNullSafe(F.col(made)), length).otherwise(F.col(counted))
    return out.withColumns(new).select(*docs.columns)
