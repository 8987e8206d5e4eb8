"""Centroid clustering in integers; the nearest centroid by a tournament of bisector planes.

For two centroids the sign of a linear form says which is nearer, so with the normals and thresholds
of all pairs made beforehand k - 1 tests find the nearest of k. Zero favours the smaller number. Only
the winner's distance is worked out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Vectors that one step of a task holds.
STEP = 1 << 13


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none NULL or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~odd, F.lit(False))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component of ``vectors`` (n, size), x as double."""
    found = np.floor(vectors.astype(np.float64) * scale)
    most = math.isqrt((1 << 60) // vectors.shape[1])  # forms and squared distances stay below 2 ** 63
    if found.size and np.abs(found).max() > most:
        raise ValueError(f"a component times {scale} exceeds {most}: distances would not fit into 64 bits")
    return found.astype(np.int64)


class Tournament:
    """The planes between all pairs of ``centroids`` (k, size)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, dtype=np.int64)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, and its squared distance."""
        winner = np.zeros(len(vectors), dtype=np.int64)
        for other in range(1, len(self.centroids)):
            form = np.einsum("ij,ij->i", vectors, self.normals[winner, other]) - self.thresholds[winner, other]
            winner[form > 0] = other
        apart = vectors - self.centroids[winner]
        return winner, np.einsum("ij,ij->i", apart, apart)


def _steps(batch: pa.RecordBatch, size: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of (key, vector), with the vectors as integers."""
    for a in range(0, batch.num_rows, STEP):
        part = batch.slice(a, STEP)
        values = part.column(1).flatten().to_numpy(zero_copy_only=False)
        yield part, integers(values.reshape(-1, size), scale)


def _sums(rows: DataFrame, planes: Tournament, size: int, scale: int) -> dict[int, list[int]]:
    """Of each centroid that has any vectors their number, distances and components, each summed.

    Every task adds up its own vectors, so k rows a task are all that moves.
    """
    schema = "cluster int, sums array<decimal(38,0)>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    k = len(planes.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, apart, sums = np.zeros(k, dtype=np.int64), [0] * k, np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            for _, found in _steps(batch, size, scale):
                winner, distance = planes.nearest(found)
                count += np.bincount(winner, minlength=k)
                np.add.at(sums, winner, found)
                for cluster in np.unique(winner).tolist():
                    apart[cluster] += sum(distance[winner == cluster].tolist())
        some = np.flatnonzero(count).tolist()
        columns = [some, [[count[c].item(), apart[c], *sums[c].tolist()] for c in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    parts = rows.mapInArrow(run, schema).select("cluster", F.posexplode("sums").alias("place", "value"))
    totals: dict[int, list[int]] = {}
    for row in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).orderBy("place").collect():
        totals.setdefault(row.cluster, []).append(int(row.value))
    return totals


def first_centroids(rows: DataFrame, k: int, size: int, seed: str, scale: int) -> np.ndarray:
    """The ``k`` of the rows (key, vector) with the smallest sha256 of ``seed``:key, in that order, as integers.

    Rows of one key are ordered by vector; a NULL key is never chosen.
    """
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.where("key IS NOT NULL").orderBy(hashed, "vector").limit(k).select("vector").collect()
    return integers(np.array([r.vector for r in first], dtype=np.float64).reshape(-1, size), scale)


def cluster(
    vectors: DataFrame, key: str, vector: str, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of every usable vector.

    Components are floor(``scale`` * x). Each round assigns all vectors to the nearest centroid
    (squared distance, on ties the smaller number) and moves every centroid that has any to the floor
    of their mean; then all are assigned once more. Rounds read the key and vector columns only, and
    only sums of k * ``size`` numbers reach the driver. Vectors of another length, NULL, or with NULL
    or non-finite components take no part. Repeated rows count as often as they occur and stay; fewer
    than k usable keys give fewer centroids, an empty table no rows. A vector without a key has no hash
    and starts no centroid (if none has a key there is no result). A component too large for exact
    64-bit distances raises.
    """
    rows = vectors.where(usable(F.col(vector), size)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, cluster int, distance bigint"
    centroids = first_centroids(rows, k, size, seed, scale)
    if not len(centroids):
        totals, planes, rows = {}, None, rows.where("false")
    else:
        for _ in range(rounds):
            for c, (count, _, *sums) in _sums(rows, Tournament(centroids), size, scale).items():
                centroids[c] = [total // count for total in sums]
        planes = Tournament(centroids)
        totals = {c: found[1] for c, found in _sums(rows, planes, size, scale).items()}
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _steps(batch, size, scale):
                winner, distance = planes.nearest(found)
                columns = [part.column(0), pa.array(winner, pa.int32()), pa.array(distance)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    named = [(c, totals[c], centroids[c].tolist()) for c in totals]
    facts = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, centroid array<bigint>")
    found = rows.mapInArrow(run, schema).join(F.broadcast(facts), "cluster")
    inertia = F.lit(sum(totals.values())).cast("bigint")
    return found.select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid"
    )
