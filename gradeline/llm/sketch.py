"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, and the smallest
hash whatever it is. Two sketches merge by union (``merged``); as the fraction is fixed, the share of
one sketch found in another estimates containment, however unequal the documents are. A smallest hash
above the fraction takes no part in that: the other sketch would hold it by chance only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: One hash in so many is kept.
SCALE = 2
SHINGLE = 5
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of a bucket that ``followed`` aims at, segments of equal counts, and the most buckets.
BUCKET_ROWS, SEGMENTS, MOST_BUCKETS = 1024, 64, 8192


def _limit(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale - 1


def sketched(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add ``name``: the sorted sketch (array of bigint) of the whole text.

    Words are what ASCII white space separates; a text of fewer than ``shingle`` words is one
    shingle. NULL, empty and blank texts have an empty sketch.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), "")
    hashed = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    places = F.sequence(F.lit(1), F.greatest(F.size("_hashes") - (shingle - 1), F.lit(1)))
    shingles = F.transform(places, lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, shingle)))
    shingled = hashed.withColumn("_hashes", F.when(F.size("_hashes") > 0, shingles).otherwise(F.array().cast("array<bigint>")))
    kept = F.filter("_hashes", lambda h: h <= _limit(scale))
    least = F.when(F.size("_hashes") > 0, F.array(F.array_min("_hashes"))).otherwise(F.array().cast("array<bigint>"))
    return shingled.withColumn(name, F.array_sort(F.array_union(kept, least))).drop("_hashes")


def merged(sketch: Column, other: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents' shingles together, from their sketches alone."""
    both = F.array_sort(F.array_union(sketch, other))
    return F.filter(both, lambda h, i: (h <= _limit(scale)) | (i == 0))


def containment(sketch: Column, other: Column, scale: int = SCALE) -> Column:
    """Estimated share (0 to 1) of the first's shingles that the second has; an empty first: 1 if both are.

    Of the hashes below the limit. A first with none is judged by its smallest hash alone: 1 if the
    second has it, 0 if the second is empty, else NULL, as nothing is known.
    """
    below = F.filter(sketch, lambda h: h <= _limit(scale))
    share = F.size(F.array_intersect(below, other)) / F.size(below)
    lone = F.when(F.arrays_overlap(sketch, other), 1.0).when(F.size(other) == 0, 0.0)
    return F.when(F.size(below) > 0, share).when(F.size(sketch) > 0, lone).otherwise((F.size(other) == 0).cast("double"))


def resemblance(sketch: Column, other: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    union = F.size(F.array_union(sketch, other))
    return F.when(union > 0, F.size(F.array_intersect(sketch, other)) / union).otherwise(F.lit(1.0))


def as_text(sketch: Column) -> Column:
    """The hashes as 16 hex digits each, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _buckets(rows: DataFrame, key: str) -> Column:
    """Number of a range of keys, rising with the key; -1 for NULL. About BUCKET_ROWS rows each.

    The keys' quantiles cut SEGMENTS segments, each is cut evenly. What the driver holds is the
    quantiles and nothing that grows with the table.
    """
    cuts = [i / SEGMENTS for i in range(1, SEGMENTS)]
    seen = rows.agg(
        F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"),
        F.percentile_approx(key, cuts, 1000).alias("cuts"),
    ).first()
    if not seen.n:
        return F.lit(-1).cast("bigint")
    per = min(MOST_BUCKETS // SEGMENTS, -(-seen.n // (SEGMENTS * BUCKET_ROWS)))
    edges = [seen.low, *sorted(set(c for c in seen.cuts if seen.low < c < seen.high)), seen.high]
    starts = F.array(*[F.lit(e).cast("bigint") for e in edges])
    place = F.least(F.size(F.filter(starts, lambda e: e <= F.col(key))), F.lit(max(1, len(edges) - 1)))
    low, high = F.element_at(starts, place), F.element_at(starts, place + 1)
    inside = F.floor((F.col(key).cast("double") - low) / F.greatest(F.coalesce(high, low).cast("double") - low, F.lit(1.0)) * per)
    return F.when(F.col(key).isNull(), -1).otherwise((place - 1) * per + F.least(inside, F.lit(per - 1))).cast("bigint")


def followed(rows: DataFrame, key: str, tie: str, carry: Column, name: str) -> DataFrame:
    """Add ``name``: ``carry`` of the next row by descending integer ``key``, the first after the last.

    NULL keys come last; equal keys are ordered by ``tie``. Rows meet in range buckets, so the rows
    are shuffled once; the first row of a bucket is sent to the bucket before it as well. At most
    MOST_BUCKETS such rows are broadcast, by key and tie only.
    """
    placed = rows.withColumn("_bucket", _buckets(rows.select(key), key))
    first = F.struct(F.coalesce(key, F.lit(-(1 << 63))).alias("key"), (-F.col(tie).cast("decimal(20,0)")).alias("tie"))
    heads = placed.select("_bucket", key, tie).groupBy("_bucket").agg(F.max(F.struct(first.alias("order"), key, tie)).alias("head"))
    by_bucket = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # the bucket table has a bounded size
    heads = heads.select(
        F.col(f"head.{key}").alias("_key"), F.col(f"head.{tie}").alias("_tie"),
        F.coalesce(F.lead("_bucket").over(by_bucket), F.min("_bucket").over(Window.partitionBy(F.lit(0)))).alias("_guest"),
    )
    met = placed.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("_key")) & (F.col(tie) == F.col("_tie")), "left")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_guest").alias("bucket"), F.lit(True).alias("guest"))
    dealt = met.withColumn("_at", F.explode(F.when(F.col("_guest").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.guest", F.desc_nulls_last(key), tie)
    out = dealt.withColumn(name, F.lead(carry).over(order)).where("NOT _at.guest")
    return out.drop("_at", "_bucket", "_key", "_tie", "_guest")


def edited_sketches(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """key, n_chars, text, sketch, edited, edited_sketch and next_sketch of every row.

    The edited text is the row's, its last half (rounded down) replaced by as many first code points
    of the next row's text, or all it has; see ``followed`` for the order. NULL texts count as empty.
    Rows with equal keys and texts stay; no other column is read, whatever it is called.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # sketches are made where the texts have met: they would be the larger part of what moves
    rows = followed(rows, "key", "tie", F.col("text"), "next").withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next", half)))
    for column, name in (("text", "sketch"), ("edited", "edited_sketch"), ("next", "next_sketch")):
        rows = sketched(rows, column, name, shingle, scale)
    return rows.select(
        F.col("key").alias(key), "n_chars", "text", "sketch", "edited", "edited_sketch", "next_sketch"
    )
