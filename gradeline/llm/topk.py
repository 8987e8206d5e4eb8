"""Exact top-k inner products over an impact-ordered index, score at a time.

The rows are dealt into shards. In a shard every non-zero component is a posting (dimension, row,
value); postings whose magnitudes lie in the same power of two form a segment, and a search takes
the segments from the largest impact down. What is left of a row below a segment has a known norm,
which bounds the rest of its score. A query stops when that proves that few rows can still be among
its best; those are scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeline.session import pin

INDEX = "shard int, impact int, dims int, ptr binary, post binary, vals binary, tail binary, keys binary, rows binary"
FOUND = "query_row bigint, query_id bigint, row bigint, id bigint, score bigint"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """row, id, x: floor(scale * component) of every usable vector.

    A vector that is NULL or holds a NULL, NaN or infinite component is left out, as is a NULL key.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    odd = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    usable = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd)
    return usable.select("row", "id", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("x"))


def _matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """List column to int64 rows, padded with zeros to the longest (or cut to ``dims``)."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), max(wide, dims or 0)), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), _within(sizes)] = flat
    return out if dims is None else out[:, :dims]


def _within(sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _segments(found: pa.Table) -> pa.Table:
    """The index of a shard: a row per impact, the largest first, and what is left below it."""
    x = _matrix(found.column("x"))
    size = np.abs(x)
    left = (x.astype(np.float64) ** 2).sum(axis=1)
    ids = found.column("id").to_numpy().astype("<i8").tobytes()
    rows = found.column("row").to_numpy().astype("<i8").tobytes()
    shard, out = found.column("shard")[0].as_py(), []
    for bit in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
        inside = (size >= 1 << bit) & (size < 2 << bit)
        dim, row = np.nonzero(inside.T)
        left = np.maximum(0.0, left - np.where(inside, x.astype(np.float64) ** 2, 0).sum(axis=1))
        out.append({
            "shard": shard, "impact": bit, "dims": x.shape[1],
            "ptr": np.searchsorted(dim, np.arange(x.shape[1] + 1)).astype("<i4").tobytes(),
            "post": row.astype("<i4").tobytes(), "vals": x[row, dim].astype("<i8").tobytes(),
            "tail": np.sqrt(left).astype("<f8").tobytes(), "keys": ids, "rows": rows,
        })
        ids = rows = None  # with the first segment only
    if not out:  # all zero
        out = [{"shard": shard, "impact": 0, "dims": x.shape[1], "ptr": np.zeros(x.shape[1] + 1, "<i4").tobytes(),
                "post": b"", "vals": b"", "tail": np.zeros(len(x), "<f8").tobytes(), "keys": ids, "rows": rows}]
    return pa.Table.from_pylist(out, schema=_arrow(INDEX))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _search(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one shard for each query of one block; ties to the smaller id, then row."""
    schema = _arrow(FOUND)
    if not index.num_rows or not queries.num_rows:
        return schema.empty_table()
    index = index.sort_by([("impact", "descending")])
    segments = index.drop_columns(["keys", "rows"]).to_pylist()
    ids = np.frombuffer(index.column("keys")[0].as_py(), dtype="<i8")
    rows = np.frombuffer(index.column("rows")[0].as_py(), dtype="<i8")
    n, dims = len(ids), segments[0]["dims"]
    q = _matrix(queries.column("x"), dims)
    q_row, q_id = queries.column("row").to_numpy(), queries.column("id").to_numpy()
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    x = np.zeros((n, dims), dtype=np.int64)  # fills up to the exact rows, segment by segment
    largest = max((int(np.abs(np.frombuffer(s["vals"], dtype="<i8")).max(initial=0)) for s in segments), default=0)
    reach = float(np.abs(q).max(initial=0)) * largest * max(dims, 1)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    order = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows, q_row, sorter=order), n - 1)
    own = np.where(rows[order[at]] == q_row, order[at], -1)

    open_q, acc = np.arange(len(q)), np.zeros((len(q), n), dtype=kind)
    best: dict[int, np.ndarray] = {}
    for i, s in enumerate(segments):
        part = np.zeros((n, dims), dtype=kind)
        post, vals = np.frombuffer(s["post"], dtype="<i4"), np.frombuffer(s["vals"], dtype="<i8")
        dim = np.repeat(np.arange(dims), np.diff(np.frombuffer(s["ptr"], dtype="<i4")))
        part[post, dim] = vals
        x[post, dim] = vals
        acc += q[open_q].astype(kind) @ part.T
        tail = np.frombuffer(s["tail"], dtype="<f8")
        last = i == len(segments) - 1
        if not last:
            rest = norm[open_q] * np.median(tail)
            if np.mean(acc.max(axis=1) - rest > acc.mean(axis=1) + rest) < 0.1:
                continue  # half of the rows may still be among the best of nearly every query
        slack = np.outer(norm[open_q], tail).astype(kind if kind != np.int64 else np.float64)
        if not last:
            slack = np.ceil(slack * (1 + 1e-5) + 1)  # safe against rounding
        has_own = np.flatnonzero(own[open_q] >= 0)
        low = acc - slack
        low[has_own, own[open_q][has_own]] = -np.inf
        sure = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_q), -np.inf)
        possible = acc + slack >= sure[:, None]
        possible[has_own, own[open_q][has_own]] = False
        count = possible.sum(axis=1)
        done = np.ones(len(open_q), bool) if last else count <= max(4 * k, n // 50)
        for j in np.flatnonzero(done):
            best[int(open_q[j])] = np.flatnonzero(possible[j])
        open_q, acc = open_q[~done], acc[~done]
        if not len(open_q):
            break
    for s in segments[i + 1 :]:  # the exact rows, for the scores
        post, vals = np.frombuffer(s["post"], dtype="<i4"), np.frombuffer(s["vals"], dtype="<i8")
        x[post, np.repeat(np.arange(dims), np.diff(np.frombuffer(s["ptr"], dtype="<i4")))] = vals
    out = {name: [] for name in schema.names}
    for j, members in best.items():
        score = x[members] @ q[j]
        top = np.lexsort((rows[members], ids[members], -score))[:k]
        out["query_row"].append(np.full(len(top), q_row[j]))
        out["query_id"].append(np.full(len(top), q_id[j]))
        out["row"].append(rows[members[top]])
        out["id"].append(ids[members[top]])
        out["score"].append(score[top])
    return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}, schema=schema)


def top_k(
    vectors: DataFrame, key: str, vector: str, every: int, k: int = 20, scale: int = 64,
    shard_rows: int = 8192, block_queries: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best other rows for every ``every``-th key.

    Score is the inner product of floor(scale * component); a shorter vector counts as padded with
    zeros. Queries are the rows whose key is divisible by ``every``; a row is never its own
    candidate, but another row with the same key or vector is. Ties go to the smaller key. Rows with
    NULL keys or unusable vectors (see ``quantised``) take no part; an empty table gives no rows.
    Shards and query blocks have a bounded size and meet pairwise, each pair in a task of its own.
    """
    rows = pin(quantised(vectors, key, vector, scale), "vectors")
    queries = rows.where(F.col("id") % every == 0)
    shards = -(-rows.count() // shard_rows) or 1
    blocks = -(-queries.count() // block_queries) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    index = pin(dealt.groupBy("shard").applyInArrow(_segments, INDEX), "index")

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int"))
    left = index.withColumn("block", every_block).groupBy("shard", "block")
    right = asked.withColumn("shard", every_shard).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(lambda a, b: _search(a, b, k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
