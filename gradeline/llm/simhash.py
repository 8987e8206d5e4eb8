"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a check of the Hamming distance.

With at most d differing bits and m blocks, two fingerprints agree on at least m - d whole blocks.
Every choice of m - d blocks is a join key. Fingerprints that share a key are first held against
the key's most frequent one; only what this leaves in different groups is joined, so a large group
of near copies costs a star and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gradeline.llm.common import free_name, map_arrow
from gradeline.llm.components import connected
from gradeline.session import pin

BITS = 64
#: Hashes of one text that are turned into bits at once.
HASHES = 1 << 18


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (uint64) have each bit, bit 0 first."""
    table = (np.arange(256)[:, None] >> np.arange(8)) & 1
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    return (counts @ table).ravel()


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _hashed(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of ``shingle`` words, in order and HASHES at once; no words give none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    last = ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1
    first = np.concatenate(([0], ends))[: len(last)]
    for a in range(0, len(last), HASHES):
        spans = zip(first[a : a + HASHES].tolist(), last[a : a + HASHES].tolist())
        yield np.array([xxh64_intdigest(line[i:j], 42) for i, j in spans], dtype=np.uint64)


def _majority(counts: np.ndarray, hashes: int) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    return _signed(sum(1 << i for i in np.flatnonzero(counts * 2 > hashes).tolist()))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """``key`` and ``fingerprint`` (bigint, the 64 bits) of every row's whole text.

    ASCII letters are lower-cased, words are what ASCII white space separates, and each run of
    ``shingle`` words, repeats included, is hashed by XXH64 with seed 42; a text of fewer words is
    one shingle. A bit is set if it is in over half the hashes. NULL, empty and blank texts get 0.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def start():
        def bits(t: str) -> int:
            counts, size = np.zeros(BITS, dtype=np.int64), 0
            for found in _hashed(t, shingle):
                counts += _bit_counts(found)
                size += len(found)
            return _majority(counts, size)

        return lambda columns: [columns[0], [bits(t) for t in columns[1]]]

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, f"key {kind}, fingerprint bigint", start).select(F.col("key").alias(key), "fingerprint")


def block_masks(distance: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks`` - ``distance`` of the blocks of 64 bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [_signed(m) for m in masks]


def block_count(rows: int, distance: int) -> int:
    """The fewest blocks whose keys have more values than there are rows, up to twice the distance."""
    blocks = distance + 1
    while blocks < 2 * distance and 1 << (BITS * (blocks - distance) // blocks) < 4 * rows:
        blocks += 1
    return blocks


def _close(distance: int) -> Column:
    """Whether the fingerprints of both sides of a join, ``fp`` and ``fp2``, are that close."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance


def _stars(values: DataFrame, blocks: Column, close: Column) -> DataFrame:
    """(node, node2, n2) of ``values`` (node bigint, fp, n: its rows): node2 heads a block of node and is ``close``.

    ``blocks`` are a row's keys; a block's most frequent row heads it.
    """
    keyed = values.select("node", "fp", "n", F.explode(blocks).alias("block"))
    heads = keyed.groupBy("block").agg(F.max(F.struct("n", "node", "fp")).alias("head"), F.count("*").alias("size"))
    heads = heads.where("size > 1").select(
        "block", F.col("head.n").alias("n2"), F.col("head.node").alias("node2"), F.col("head.fp").alias("fp2")
    )
    stars = keyed.join(heads, "block").where((F.col("node") != F.col("node2")) & close)
    return stars.select("node", "node2", "n2")


def _across(grouped: DataFrame, blocks: Column, close: Column) -> DataFrame:
    """(node, group, node2, group2) of the ``close`` rows of ``grouped`` (node, fp, group) that share a block, not a group.

    Of two groups in a block one is not its largest, so the others are joined with all.
    """
    keyed = grouped.select("node", "fp", "group", F.explode(blocks).alias("block"))
    sizes = keyed.groupBy("block", "group").agg(F.count("*").alias("size"))
    main = sizes.groupBy("block").agg(F.max(F.struct("size", "group")).alias("main"), F.count("*").alias("groups"))
    main = main.where("groups > 1").select("block", F.col("main.group").alias("main"))
    rest = keyed.join(main, "block").where("group <> main")
    rest = rest.select("block", F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.col("group").alias("group2"))
    pairs = rest.join(keyed, "block").where((F.col("group2") != F.col("group")) & close)
    return pairs.select("node", "group", "node2", "group2")


def _grouped(values: DataFrame, components: DataFrame) -> DataFrame:
    """(node, fp, group) of ``values``: its component, or itself."""
    found = values.select("node", "fp").join(components, "node", "left")
    return pin(found.select("node", "fp", F.coalesce("component", "node").alias("group")), "groups")


def _regrouped(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, group) after groups joined by ``edges`` (a, b) have become one."""
    merged = connected(edges).withColumnRenamed("node", "group")
    final = grouped.select("node", "group").join(merged, "group", "left")
    return final.select("node", F.coalesce("component", "group").alias("group"))


def _linked(values: DataFrame, blocks: Column, close: Column) -> DataFrame:
    """(node, group) of ``values``: rows that share a block and are ``close`` are linked; group is the smallest node."""
    stars = _stars(values, blocks, close)
    grouped = _grouped(values, connected(stars.select(F.col("node").alias("a"), F.col("node2").alias("b"))))
    pairs = _across(grouped, blocks, close)
    return _regrouped(grouped, pairs.select(F.col("group2").alias("a"), F.col("group").alias("b")))


def linked(values: DataFrame, distance: int, blocks: int | None = None) -> DataFrame:
    """(fp, group) of the distinct fingerprints ``values`` (fp bigint, n: its rows).

    Fingerprints are in one group if a chain of steps of at most ``distance`` bits joins them; the
    group is the smallest fingerprint in it, as a signed number. Exact for every number of blocks.
    Equal keys of two choices of blocks only add a comparison.
    """
    masks = block_masks(distance, blocks or block_count(values.count(), distance))
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    nodes = values.select(F.col("fp").alias("node"), "fp", "n")
    return _linked(nodes, F.array(*keys), _close(distance)).withColumnRenamed("node", "fp")


def near_groups(
    docs: DataFrame, key: str, text: str, shingle: int = 4, distance: int = 4, blocks: int | None = None
) -> DataFrame:
    """``key``, ``fingerprint`` (bigint) and ``component`` of every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component`` is the
    smallest key that links reach, the row's own included. Texts without words have fingerprint 0
    and are linked like any other. Repeated rows stay; a NULL key never names a component, so a
    component of NULL keys only has NULL. An empty table gives no rows.
    """
    rows = fingerprints(docs, key, text, shingle).select(F.col(key).alias("key"), F.col("fingerprint").alias("fp"))
    rows = pin(rows, "fingerprints")
    values = pin(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("key").alias("least")), "values")
    groups = values.select("fp", "least").join(linked(values.select("fp", "n"), distance, blocks), "fp")
    groups = pin(groups, "groups")
    names = groups.groupBy("group").agg(F.min("least").alias("component"))
    named = groups.join(names, "group").select("fp", "component")
    return rows.join(named, "fp").select(
        F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component"
    )


def keep_one(docs: DataFrame, text: str, order: str, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of ``near_groups``.

    The row with the smallest ``order`` stays, NULL being the largest, on ties that with the smaller
    hash of its text. A row is known by its ``order`` and text, so nothing but these moves; of rows
    equal in both one stays. Texts without words are one group.
    """
    key = free_name(docs, "_near_key")
    marked = docs.withColumn(key, F.struct(F.col(order).alias("order"), F.xxhash64(text).alias("text")))
    groups = near_groups(marked, key, text, shingle, distance).withColumnRenamed(key, "key")
    sized = groups.groupBy("component", "key").agg(F.count("*").alias("times"))
    place = F.struct(F.col("key.order").isNull().alias("none"), F.col("key.order"), F.col("key.text"), "times")
    kept = sized.groupBy("component").agg(F.min(place).alias("best"))
    kept = pin(kept.select(F.struct("best.order", "best.text").alias(key), F.col("best.times").alias("times")), "kept")
    once = marked.join(kept.where("times = 1").select(key), key, "left_semi")
    more = marked.join(kept.where("times > 1").select(key), key, "left_semi").dropDuplicates([key])
    return once.unionByName(more).select(*docs.columns)
