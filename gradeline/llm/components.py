"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.session import pin


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node that has edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(_nearest(both), "u").where("v > u")
    return hung.select(F.col("v").alias("u"), F.least("least", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    near = _nearest(edges)
    moved = edges.join(near, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return near.select("u", F.col("least").alias("v")).unionByName(moved)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: bigint); component is its smallest node.

    Each round is two joins and two sums with map-side combining and is written to shared storage;
    the number of rounds grows with the logarithm of the table. Loops and repeats are fine; no
    edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = pin(edges.distinct(), "edges")
    before, now = None, _state(edges)
    while before != now:
        edges = pin(_small_star(_large_star(edges)).distinct(), "edges")
        before, now = now, _state(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
