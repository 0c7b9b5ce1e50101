"""Per-group operators that keep a hot group out of a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark limits window groups before the shuffle up to this k on its own
# (spark.sql.optimizer.windowGroupLimitThreshold).
_NATIVE_LIMIT = 1000
_SALTS = 64


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of each group with their rank; ``order`` must be total.

    For a usual ``k`` Spark cuts each group to k rows per input partition before
    it shuffles. For a larger one the group is cut in salted parts first.
    """
    if k > _NATIVE_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_part_rank", F.row_number().over(part))
            .filter(F.col("_part_rank") <= k)
            .drop("_part_rank", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the row with the smallest ``order`` values of each group.

    An aggregate, not a window: copies collapse before the shuffle, so a group
    that holds a third of all rows costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def carry_forward(
    df: DataFrame,
    levels: Sequence[Sequence[str]],
    order: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Fill nulls of ``values`` with the latest value at or before the row.

    ``levels`` lists the grouping columns from the finest block to the whole
    group, each containing the next, for instance
    ``[(doc, chapter, page), (doc, chapter), (doc,)]``; every block must be a
    contiguous run of its parent. A row looks in its own block first, and blocks
    hand on only their last values, so no task sorts a whole group.
    """
    block, *parents = [list(level) for level in levels]
    window = Window.partitionBy(*block).orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = df.withColumns({v: F.last(v, ignorenulls=True).over(so_far) for v in values})
    if not parents:
        return filled
    position = F.struct(*order)
    last_values = df.groupBy(*block).agg(
        F.min(position).alias("_at"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), position)).alias(v) for v in values],
    )
    entering = carry_before(last_values, parents, values)
    return (
        filled.join(
            entering.select(*block, *[F.col(v).alias(f"_in_{v}") for v in values]), block, "left"
        )
        .withColumns({v: F.coalesce(F.col(v), F.col(f"_in_{v}")) for v in values})
        .select(*df.columns)
    )


def carry_before(
    blocks: DataFrame, levels: Sequence[Sequence[str]], values: Sequence[str]
) -> DataFrame:
    """Latest value strictly before each block, over ever coarser parents."""
    parent, *further = [list(level) for level in levels]
    before = (
        Window.partitionBy(*parent).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    filled = blocks.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in values})
    if not further:
        return filled
    summary = blocks.groupBy(*parent).agg(
        F.min("_at").alias("_at"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in values],
    )
    entering = carry_before(summary, further, values)
    return (
        filled.join(
            entering.select(*parent, *[F.col(v).alias(f"_in_{v}") for v in values]),
            parent,
            "left",
        )
        .withColumns({v: F.coalesce(F.col(v), F.col(f"_in_{v}")) for v in values})
        .select(*blocks.columns)
    )
