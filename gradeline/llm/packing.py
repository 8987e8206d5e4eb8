"""Lexical retrieval packing of documents into fixed windows.

Documents are tokenised once. What fills whole windows is cut off; the rests are dealt into shards
by their most telling term. Each shard holds a BM25 inverted index; a seed document takes the unused
neighbours that the index ranks highest until its window is full, the last of them cut.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeline.llm.common import map_arrow, slices
from gradeline.session import pin

#: A rest is cut at multiples of so many ids, whose running checksums its row carries.
GRID = 16
#: Documents of a shard, and the BM25 constants.
SHARD, K1, B = 2048, 1.2, 0.75
#: A term in more than one in so many of a shard's documents has a weight for each instead of postings.
OFTEN = 16
#: Seeds whose frequent terms are looked up together.
SEEDS = 64
#: Bytes of text, or of ids, that are worked on together.
SLICE = 1_000_000
#: Distinct words whose ids a task remembers before it starts anew.
WORDS_KEPT = 300_000
#: Letters below this have one code point in either case, but for the dotted I, and no composition.
LATIN_END = "\u0250"
#: White space of the first 256 code points; what is neither that nor a letter or number is a mark.
_BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0")
_MARKS = "".join(c for c in map(chr, range(256)) if c not in _BLANKS and unicodedata.category(c)[0] not in "LN")
#: For each of the first 256 code points, whether it is a mark.
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in _MARKS])
#: Marks that end a piece between blanks after a letter, in a text of any code points.
CLOSING_LETTER = re.compile(r"([^\W\d_\u0130])([!-/:-@\[-`{-~]+)(?= |\Z)")
#: The character that stands for a byte in a byte-level vocabulary: itself if visible, else the next from 256 on.
_SHOWN = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
_LETTER_OF_BYTE = "".join(BYTE_LETTERS.get(b, chr(b)) for b in range(256))


class _WordIds(dict):
    """Word -> its ids, worked out when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.letters = all(self.of_letters(w) == self.whole(w) for w in ("tree", "\xe9t\xe9", "stra\xdfe", "\u0153uvre"))

    def whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_letters(self, word: str) -> bytes:
        """Ids of a lower-case word of letters, by the model's merges alone."""
        if not word.isascii():
            word = codecs.charmap_decode(word.encode(), "strict", _LETTER_OF_BYTE)[0]
        id_bytes = self.id_bytes
        return b"".join([id_bytes[token.id] for token in self.merge(word)])

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
            self[""] = b""
        low = word.lower()
        if not (self.letters and low.isalpha()):
            ids = self.whole(word)
        elif low.isascii():
            id_bytes = self.id_bytes
            ids = b"".join([id_bytes[token.id] for token in self.merge(low)])
        else:
            ids = self.of_letters(low) if max(low) < LATIN_END and len(low) == len(word) else self.whole(word)
        self[word] = ids
        return ids


def _closing_apart(text: bytes) -> bytes:
    """A Latin-1 text with a blank before every run of marks that ends at a blank or the text's end."""
    chars = np.frombuffer(b" %b " % text, dtype=np.uint8)
    marks = _IS_MARK[chars]
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1  # where a run begins, where it has ended, and so on
    at = edges[::2][chars[edges[1::2]] == 32]
    old = np.ones(len(chars) + len(at), dtype=bool)
    old[at + np.arange(len(at))] = False
    apart = np.full(len(old), 32, dtype=np.uint8)
    apart[old] = chars
    return apart[1:-1].tobytes()


def _pieces(texts: list[str]) -> list[str]:
    """The texts with a blank for every line feed, and one before closing marks where that is the same to a tokenizer.

    Latin-1 texts are done together, with a line feed between two of them.
    """
    out, plain, at = [t.replace("\n", " ") for t in texts], [], []
    for i, text in enumerate(out):
        if "<|" not in text:
            try:
                plain.append(text.lower().encode("latin-1"))
                at.append(i)
            except UnicodeEncodeError:
                out[i] = CLOSING_LETTER.sub(r"\1 \2", text)
    if plain:
        for i, text in zip(at, _closing_apart(b" \n ".join(plain)).decode("latin-1").split(" \n ")):
            out[i] = text
    return out


def texts_ids(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Texts -> the ids of all of them in a row, and where each text's ids end, by a tokenizer that drops white space.

    Such a tokenizer treats what blanks separate apart, and lower-cases, so ids are remembered per
    piece between blanks (space, line feed), and the whole text's ids are those of its pieces in a
    row. Marks that end a piece are apart from the letters before them for the tokenizer too, so a
    blank is put between: far fewer pieces are then different. A new word of Latin letters has
    nothing else to normalise, and its merges are asked of the model itself; any other new piece
    goes through the tokenizer. A text that may hold a special token's name is cut at blanks only.
    Each different piece of the texts is looked up once.
    """
    known = _WordIds(path)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(pa.array(_pieces(texts), type=pa.large_string()), " ")
        pieces = cut.values.dictionary_encode()
        number = pieces.indices.to_numpy()
        ids = list(map(known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        table = np.frombuffer(b"".join(ids), dtype="<u4")
        first, held = (np.cumsum(size) - size)[number], size[number]
        end = np.cumsum(held)
        found = table[np.repeat(first - end + held, held) + np.arange(end[-1] if len(end) else 0)]
        return found, np.append(0, end)[cut.offsets.to_numpy()[1:]]

    return encode


def word_ids(path: str) -> Callable[[str], bytes]:
    """Text -> its ids, little-endian unsigned 32-bit, as ``texts_ids`` finds them."""
    encode = texts_ids(path)
    return lambda text: encode([text])[0].tobytes()


def _extended(
    df: DataFrame, keep: list[str], added: str, start: Callable[[], Callable[[pa.RecordBatch], list]]
) -> DataFrame:
    """The columns ``keep`` as they are, which become no Python objects, and the columns ``added``.

    ``start`` runs once per task and returns the function from a slice of rows to their new columns.
    """
    kinds, arrow = dict(df.dtypes), to_arrow_schema(StructType.fromDDL(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            for part in slices(batch, SLICE):
                new = [pa.array(c, type=f.type) for c, f in zip(step(part), arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, *arrow.names])

    return df.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), added]))


def _objects(rows: pa.RecordBatch, *names: str) -> list[list]:
    """Columns without NULL as lists of Python objects."""
    return [rows.column(n).to_numpy(zero_copy_only=False).tolist() for n in names]


def tokenised(docs: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    """``key``, ``ids`` (binary) of every row's whole text, ``end_id`` behind; NULL counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = np.array([end_id], dtype="<u4").tobytes()

    def start():
        encode = texts_ids(path)

        def step(columns):
            ids, ends = encode(columns[1])
            return [columns[0], [part.tobytes() + last for part in np.split(ids, ends[:-1])]]

        return step

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, ids binary", start).withColumnRenamed("key", key)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(ordered)]


_SHAPE = "n_ids bigint, whole binary, marks binary, terms binary, counts binary"


def _shapes(found: np.ndarray, ends: np.ndarray, end_id: int, window: int) -> list[list]:
    """Of each text, from the ids of all and where each text's end; ``end_id`` comes behind every text's ids.

    The columns: count, checksums of whole windows, running checksums of the rest, distinct terms and their counts.
    """
    size, last, wide = np.diff(ends, prepend=0), np.array([end_id], dtype="<u4").tobytes(), 4 * window
    whole, marks = [], []
    for a, b in zip((ends - size).tolist(), ends.tolist()):
        ids = found[a:b].tobytes() + last
        rest = len(ids) // wide * wide
        whole.append(array("I", [zlib.crc32(ids[i : i + wide]) for i in range(0, rest, wide)]).tobytes())
        crc, running = 0, [0]
        for i in range(rest, len(ids), 4 * GRID):
            crc = zlib.crc32(ids[i : i + 4 * GRID], crc)
            running.append(crc)
        marks.append(array("I", running).tobytes())
    every = np.repeat(np.arange(len(size)) << 32, size) | found
    every.sort()
    new = _firsts(every)
    times = np.diff(new, append=len(every)).astype("<u4").tobytes()
    terms = every[new]
    edges = np.searchsorted(terms >> 32, np.arange(len(size) + 1)) * 4
    terms = terms.astype("<u4").tobytes()  # without the text's number above
    parts = list(zip(edges.tolist(), edges[1:].tolist()))
    return [(size + 1).tolist(), whole, marks, [terms[a:b] for a, b in parts], [times[a:b] for a, b in parts]]


def shaped(docs: DataFrame, key: str, text: str, path: str, end_id: int, window: int) -> DataFrame:
    """key, and what packing needs to know of a document's ids, without the ids."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        encode = texts_ids(path)
        return lambda part: _shapes(*encode(*_objects(part, "text")), end_id, window)

    return _extended(rows, ["key"], _SHAPE, start)


def document_counts(shapes: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each term is, over all documents; as long as the vocabulary."""

    def count(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            joined = b"".join(v for v in batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(joined, dtype="<u4"), minlength=vocabulary)
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms])], names=["term", "n"])

    sums = shapes.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, dtype=np.int64)
    for row in sums.collect():  # one row per term of the vocabulary at most
        out[row.term] = row.n
    return out


class Weights:
    """BM25 term weights from the corpus: idf per term and the mean length."""

    def __init__(self, document_counts: np.ndarray, documents: int, mean: float):
        self.idf = np.log1p((documents - document_counts + 0.5) / (document_counts + 0.5))
        self.mean = max(mean, 1.0)

    def of(self, terms: np.ndarray, counts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        bent = counts + K1 * (1 - B + B * length / self.mean)
        return self.idf[terms] * counts * (K1 + 1) / bent

    def telling(self, terms: list[bytes], counts: list[bytes], lengths: list[int]) -> np.ndarray:
        """The term with the largest weight of each document, the first of equal ones; -1 without terms."""
        t, c = (np.frombuffer(b"".join(v), dtype="<u4") for v in (terms, counts))
        size = np.array([len(v) // 4 for v in terms], dtype=np.int64)
        held, out = size > 0, np.full(len(size), -1, dtype=np.int64)
        if held.any():
            value = self.of(t, c, np.repeat(np.array(lengths, dtype=np.int64), size))
            first = (np.cumsum(size) - size)[held]
            most = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), size[held]))
            out[held] = t[most[np.searchsorted(most, first)]]
        return out


def _shards(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each telling term its first shard and how many it is dealt over; shards of about SHARD rows."""
    terms, first, spread, shard, room = sorted(found), [], [], 0, SHARD
    for term in terms:
        n = found[term]
        if n > SHARD:  # shards of its own
            shard += room < SHARD
            first.append(shard)
            spread.append(-(-n // SHARD))
            shard, room = shard + spread[-1], SHARD
            continue
        if n > room:
            shard, room = shard + 1, SHARD
        first.append(shard)
        spread.append(1)
        room -= n
    return np.array(terms, dtype=np.int64), np.array(first, dtype=np.int64), np.array(spread, dtype=np.int64)


PIECE_ROW = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _crc(marks: np.ndarray, a: int, b: int, size: int) -> int:
    """Checksum of ids a to b of a rest of ``size`` ids, from its running checksums."""
    end = marks[-1] if b == size else marks[b // GRID]
    zeros = bytes(4 * (b - a))
    return int(end) ^ zlib.crc32(zeros, int(marks[a // GRID])) ^ zlib.crc32(zeros) if a else int(end)


class _Index:
    """Inverted index of a shard: postings (document, weight) by term; frequent terms as whole rows."""

    def __init__(self, rows: list[dict], weights: Weights):
        self.query = [np.frombuffer(r["terms"], dtype="<u4") for r in rows]
        counts = [np.frombuffer(r["counts"], dtype="<u4") for r in rows]
        scored = [weights.of(t, c, r["n_ids"]) for t, c, r in zip(self.query, counts, rows)]
        self.n = len(rows)
        every = np.concatenate(self.query)
        order = np.argsort(every, kind="stable")
        docs = np.repeat(np.arange(self.n), [len(t) for t in self.query])[order]
        value = np.concatenate(scored)[order]
        ordered = every[order]
        first = _firsts(ordered)
        self.terms, size = ordered[first], np.diff(first, append=len(ordered))
        number = np.repeat(np.arange(len(first)), size)
        often = size * OFTEN > self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.whole = np.zeros((int(often.sum()), self.n))
        held = often[number]
        self.whole[self.row[number[held]], docs[held]] = value[held]
        self.docs, self.weights = docs[~held], value[~held]
        self.ends = np.cumsum(np.where(often, 0, size))
        self.sizes = np.where(often, 0, size)
        self.ready: dict[int, np.ndarray] = {}

    def prepare(self, seeds: list[int]) -> None:
        """Work out together what the frequent terms of the next seeds give every document."""
        asked = np.zeros((len(seeds), len(self.whole)))
        for i, seed in enumerate(seeds):
            rows = self.row[np.searchsorted(self.terms, self.query[seed])]
            asked[i, rows[rows >= 0]] = 1
        self.ready = dict(zip(seeds, asked @ self.whole))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of the seed, which is prepared."""
        asked = np.searchsorted(self.terms, self.query[seed])
        size = self.sizes[asked]
        step = np.cumsum(size)
        hits = np.repeat(self.ends[asked] - step, size) + np.arange(step[-1] if len(step) else 0)
        return self.ready[seed] + np.bincount(self.docs[hits], self.weights[hits], minlength=self.n)


def pack_shard(rows: list[dict], shard: int, weights: Weights, window: int) -> list[tuple]:
    """(row, start, length, crc, tokens, sequence, offset) of every piece of the shard's documents.

    Seeds go by descending rest; ties in all choices go to the earlier row.
    """
    out, sequence = [], shard << 32
    size = np.array([r["n_ids"] % window for r in rows], dtype=np.int64)
    base = [r["n_ids"] - int(s) for r, s in zip(rows, size)]
    for i, r in enumerate(rows):
        for j, crc in enumerate(np.frombuffer(r["whole"], dtype="<u4").tolist()):
            out.append((i, j * window, window, crc, r["n_ids"], sequence, 0))
            sequence += 1
    marks = [np.frombuffer(r["marks"], dtype="<u4") for r in rows]
    index, taken = _Index(rows, weights), np.zeros(len(rows), dtype=np.int64)
    left = size.copy()

    def place(i: int, offset: int, room: int) -> int:
        """Put in what fits of a rest, and return its length; a part ends on the grid."""
        n = int(left[i]) if left[i] <= room else room // GRID * GRID
        a = int(taken[i])
        crc = _crc(marks[i], a, a + n, int(size[i]))
        out.append((i, base[i] + a, n, crc, rows[i]["n_ids"], sequence, offset))
        taken[i] += n
        left[i] -= n
        return n

    order = np.argsort(-size, kind="stable")
    for at, seed in enumerate(order.tolist()):
        while left[seed]:
            if seed not in index.ready:
                index.prepare([s for s in order[at : at + 2 * SEEDS].tolist() if left[s]][:SEEDS])
            used = place(seed, 0, window)
            if window - used >= GRID:
                scores = index.scores(seed)
                scores[left == 0] = -1
                while window - used >= 1 and (open_ := left > 0).any():
                    room = window - used
                    if room < GRID:  # only a rest that fits whole
                        scores[left > room] = -1
                    best = int(np.argmax(scores))
                    if scores[best] < 0:
                        break
                    used += place(best, used, room)
                    if not left[best]:
                        scores[best] = -1
            sequence += 1
    return out


def pack(docs: DataFrame, key: str, text: str, path: str, end_id: int, window: int = 2048) -> DataFrame:
    """A row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row, ``end_id`` behind its text included, lies in one piece; a NULL or empty
    text is that one id. Pieces of a sequence lie side by side from offset 0 and fill ``window`` up
    to a few ids, but for the last sequence of a shard. Repeated rows and NULL keys are packed like
    any other; no other column is read; an empty table gives no rows.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(path).get_vocab().values()) + 1
    numbered = docs.select(
        F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("id"), F.col(text).alias("text")
    )
    shapes = pin(shaped(numbered, "id", "text", path, end_id, window), "shapes").withColumnRenamed("key", "id")
    seen = shapes.agg(F.count("*").alias("n"), F.avg("n_ids").alias("mean")).first()
    weights = Weights(document_counts(shapes, vocabulary), seen.n, seen.mean or 1.0)

    def telling(part: pa.RecordBatch) -> np.ndarray:
        return weights.telling(*_objects(part, "terms", "counts", "n_ids"))

    chosen = _extended(shapes.select("terms", "counts", "n_ids"), [], "term bigint", lambda: lambda part: [telling(part)])
    terms, first, spread = _shards({r.term: r["count"] for r in chosen.groupBy("term").count().collect()})

    def dealt(part: pa.RecordBatch) -> list[np.ndarray]:
        at = np.searchsorted(terms, telling(part))
        row = part.column("id").flatten()[0].to_pylist()
        salt = [zlib.crc32(str(r).encode()) for r in row]
        return [first[at] + np.array(salt, dtype=np.int64) % spread[at]]

    def packed(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["id"]["row"])
        pieces = pack_shard(rows, rows[0]["shard"], weights, window)
        ids = pa.array([rows[p[0]]["id"]["key"] for p in pieces], type=found.schema.field("id").type.field("key").type)
        names = [f.split()[0] for f in PIECE_ROW.split(", ")]
        values = [pa.array([p[i] for p in pieces], type=pa.int64()) for i in range(1, 7)]
        return pa.Table.from_arrays([ids, *values], names=["key", *names])

    rows = _extended(shapes, shapes.columns, "shard bigint", lambda: dealt)
    key_kind = dict(docs.dtypes)[key]
    return rows.groupBy("shard").applyInArrow(packed, f"key {key_kind}, {PIECE_ROW}").withColumnRenamed("key", key)


def sequences(pieces: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """sequence_id and ``ids`` (binary) of every sequence, from the pieces and the documents' ids.

    ``key`` must name a document once. Joins by key; a sequence is at most a window long.
    """
    cut = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    parts = pieces.join(tokens, key).select("sequence_id", F.struct("offset", cut.alias("part")).alias("piece"))
    listed = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p.part))
    return listed.select("sequence_id", joined.alias("ids"))
