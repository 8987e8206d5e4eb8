"""Quoted CSV read in parts: records that hold line breaks do not keep a file from being cut.

Whether a line starts inside a quoted field is the parity of the quote marks before it. Parities of
splits are counted, accumulated over each file and handed to the splits, which then tell record ends
from quoted line breaks. The two ends of a record that a cut runs through meet afterwards.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gradeline.session import pin

#: ``place`` of a text: the end of a record of an earlier split (or its middle), a whole record, a start.
END, WHOLE, START = -1, 0, 1
RECORD = "file_path string, block_start bigint, place int, head boolean, text string"
FIELDS = pa.schema(
    {"file_path": pa.string(), "block_start": pa.int64(), "place": pa.int32(), "head": pa.bool_(), "text": pa.string()}
)
OPTIONS = {
    "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": "20480", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false", "multiLine": "true", "lineSep": "\n",
}


def _start_parities(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The splits (sorted 64-bit hashes) and whether each starts inside a quoted field.

    Nine bytes a split reach the driver: some 7 MB for 100 TB in splits of 128 MB.
    """
    marks = F.length("value") - F.length(F.replace("value", F.lit('"')))
    splits = lines.groupBy("file_path", "block_start", "split").agg((F.sum(marks) % 2).alias("odd"))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("boolean").alias("inside"))
    found = starts.toArrow().sort_by("split")
    return found["split"].to_numpy(), found["inside"].to_numpy()


class _Cutter:
    """The records of one split, line by line in order."""

    def __init__(self, path: str, start: int, inside: bool):
        self.path, self.start = path, start
        self.inside, self.fresh, self.open, self.head = inside, inside, [], start == 0

    def feed(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        marks = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
        inside = (np.cumsum(marks) + self.inside) % 2
        self.inside = bool(inside[-1])
        ends = np.flatnonzero(inside == 0)
        if not ends.size:
            self.open += values.to_pylist()
            return
        self.open += values.slice(0, int(ends[0]) + 1).to_pylist()
        yield self._made(END if self.fresh else WHOLE, [self._joined()])
        self.fresh = False
        edges = pa.array(ends - ends[0], type=pa.int32())
        inner = values.slice(int(ends[0]) + 1, int(ends[-1] - ends[0]))
        if len(ends) > 1:
            yield self._made(WHOLE, pc.binary_join(pa.ListArray.from_arrays(edges, inner), "\n"))
        self.open = values.slice(int(ends[-1]) + 1).to_pylist()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._made(END if self.fresh else START, [self._joined()])

    def _joined(self) -> str:
        text, self.open = "\n".join(self.open), []
        return text

    def _made(self, place: int, texts: list[str] | pa.Array) -> pa.RecordBatch:
        n = len(texts)
        head = [self.head, *[False] * (n - 1)]
        self.head = False
        columns = [[self.path] * n, [self.start] * n, [place] * n, head, texts]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, FIELDS)]
        return pa.RecordBatch.from_arrays(arrays, schema=FIELDS)


def _cut(lines: DataFrame, splits: np.ndarray, inside: np.ndarray) -> DataFrame:
    """The records and parts of records of every split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at = None, None
        for batch in batches:
            keys = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if cutter is None or at != keys[a]:
                    if cutter is not None:
                        yield from cutter.rest()
                    at = keys[a]
                    place = np.searchsorted(splits, at)
                    if place == len(splits) or splits[place] != at:
                        raise ValueError("the input was cut differently in two scans of it")
                    cutter = _Cutter(batch.column(1)[a].as_py(), batch.column(2)[a].as_py(), bool(inside[place]))
                yield from cutter.feed(batch.column(0).slice(a, b - a))
        if cutter is not None:
            yield from cutter.rest()

    return lines.mapInArrow(run, RECORD)


def _mended(records: DataFrame) -> DataFrame:
    """(file_path, head, text) of the records that cuts run through, put together from their parts.

    Parts are numbered by how many starts lie before them; only their names go through the window.
    """
    parts = records.where(F.col("place") != WHOLE)
    order = Window.partitionBy("file_path").orderBy("block_start", "place")
    number = F.sum((F.col("place") == START).cast("bigint")).over(order)
    numbered = parts.select("file_path", "block_start", "place").withColumn("number", number)
    piece = F.struct("block_start", "place", "text")
    whole = parts.join(numbered, ["file_path", "block_start", "place"]).groupBy("file_path", "number").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.bool_or("head").alias("head")
    )
    return whole.select("file_path", "head", F.array_join("pieces.text", "\n").alias("text"))


def csv_records(lines: DataFrame) -> DataFrame:
    """(file_path, head, text) of every record of ``lines`` (value, file_path, block_start), written once.

    ``head`` marks the first record of a file. A record ends at a line end outside quotes; the line
    end itself, '\\n' or '\\r\\n', is no part of it. Blank lines are no records. What is returned no
    longer depends on how the scans were cut.
    """
    named = lines.select("value", "file_path", "block_start", F.xxhash64("file_path", "block_start").alias("split"))
    records = pin(_cut(named, *_start_parities(named)), "records")
    whole = records.where(F.col("place") == WHOLE).select("file_path", "head", "text")
    found = whole.unionByName(pin(_mended(records), "mended"))
    return found.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def parse_records(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ``columns`` of CSV records, by the names in the header of each one's file; all strings, empty for none."""
    heads = records.where("head").select("file_path", "text")
    rows, out = records.where("NOT head"), None
    headers = [r.text for r in heads.select("text").distinct().collect()]  # one for each order of columns in use
    for header in sorted(headers):
        names = next(csv.reader([header]))
        if lacking := set(columns).difference(names):
            raise ValueError(f"no column {sorted(lacking)} in a file with the header {header[:200]}")
        own = rows if len(headers) == 1 else rows.join(heads.where(F.col("text") == header).select("file_path"), "file_path", "left_semi")
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        fields = [F.col(f"r.c{names.index(c)}").alias(c) for c in columns]
        part = own.select(F.from_csv("text", schema, OPTIONS).alias("r")).select(*fields)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select(*[F.lit("").alias(c) for c in columns])
    return out.na.fill("")
