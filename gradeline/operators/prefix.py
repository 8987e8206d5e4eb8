"""Running sums and ranks over a total order, without one task per group.

A window ordered over a whole group runs in a single task, which a group that holds a third of a
large table does not survive. Rows are cut into consecutive blocks of a bounded size, each block is
summed, the (few) block sums are accumulated, and a window runs inside each block. There is no other
path: small tables are one block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeline.session import pin

BLOCK = "_block"
#: Rows that one task sorts; the number of blocks follows from the number of rows.
BLOCK_ROWS = 1 << 20
#: Rows below which a block is not made smaller to give every core one.
LEAST_ROWS = 1 << 15


def prefix_sums(
    df: DataFrame,
    sums: Mapping[str, Column | str],
    order_by: Sequence[str],
    within: Sequence[str] = (),
    as_type: str = "bigint",
    opening: DataFrame | None = None,
) -> DataFrame:
    """Add one exclusive running sum of ``as_type`` per entry of ``sums`` (new name -> summed column).

    ``order_by`` must order the rows of a group totally; NULL group keys are a group. ``opening``
    (the group keys and a column per new name, a row per group) is what each sum starts from. Rows
    are written first, so select what is needed: costly columns are then worked out once, and the
    file footers tell how many blocks there are to be. The blocks are Spark's own range partitions
    over (within, order_by), so hot groups and hot values are split by their actual distribution;
    they are pinned, because two evaluations would sample different bounds.
    """
    rows = pin(df, "rows")
    blocks = block_count(rows.count(), df.sparkSession.sparkContext.defaultParallelism)
    ranged = rows.repartitionByRange(blocks, *within, *order_by).withColumn(BLOCK, F.spark_partition_id())
    return sums_over_blocks(pin(ranged, "ranged"), sums, order_by, within, as_type, opening=opening).drop(BLOCK)


def block_count(rows: int, cores: int) -> int:
    """Blocks for so many rows: none beyond BLOCK_ROWS, and one a core where that leaves LEAST_ROWS in each."""
    return max(1, -(-rows // BLOCK_ROWS), min(cores, rows // LEAST_ROWS))


def _as_columns(sums: Mapping[str, Column | str]) -> dict[str, Column]:
    return {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}


def sums_over_blocks(
    df: DataFrame,
    sums: Mapping[str, Column | str],
    order_by: Sequence[str],
    within: Sequence[str] = (),
    as_type: str = "bigint",
    keep: Column | None = None,
    opening: DataFrame | None = None,
) -> DataFrame:
    """The same for rows that already carry a block number, from 0, growing with ``order_by``.

    Rows shuffle once, by (within, block), which serves the join and the window alike; the group keys
    meet as a struct, in which NULLs are equal. ``keep`` is a condition on the blocks'
    ``_base_<name>``; rows of other blocks are left out.
    """
    parts = _as_columns(sums)
    bases = block_bases(df, parts, within, as_type, opening)
    if keep is not None:
        bases = bases.where(keep)
    keys = ["_group", BLOCK]
    grouped = df.withColumn("_group", _group(within))
    inside = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    running = {
        name: (F.col(f"_base_{name}") + _zero_if_none(F.sum(c).over(inside), as_type)).cast(as_type)
        for name, c in parts.items()
    }
    bases = bases.select(_group(within).alias("_group"), BLOCK, *[f"_base_{name}" for name in parts])
    return grouped.join(bases, keys).withColumns(running).drop("_group", *[f"_base_{name}" for name in parts])


def _group(within: Sequence[str]) -> Column:
    return F.struct(*within) if within else F.lit(0)


def block_bases(
    df: DataFrame, parts: Mapping[str, Column], within: Sequence[str] = (), as_type: str = "bigint",
    opening: DataFrame | None = None,
) -> DataFrame:
    """Per (within, block): ``opening`` plus the sum over all earlier blocks of the group, as ``_base_<name>``."""
    totals = df.groupBy(*within, BLOCK).agg(*[F.sum(c).cast(as_type).alias(name) for name, c in parts.items()])
    if opening is not None:
        first = [F.col(name).cast(as_type).alias(name) for name in parts]
        totals = opening.select(*within, F.lit(-1).cast(dict(df.dtypes)[BLOCK]).alias(BLOCK), *first).unionByName(totals)
    before = Window.partitionBy(*within).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *within, BLOCK, *[_zero_if_none(F.sum(n).over(before), as_type).alias(f"_base_{n}") for n in parts]
    )


def _zero_if_none(total: Column, as_type: str) -> Column:
    return F.coalesce(total.cast(as_type), F.lit(0).cast(as_type))


def idx_block(idx: Column) -> Column:
    """Block number of a dense row index, BLOCK_ROWS rows each: no scan is needed to find the cuts."""
    return F.floor(idx / BLOCK_ROWS).cast("bigint")
