"""Image pairs compared by matrices of their features (keypoints, variants)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.session import cut_lineage

PAIR = ["ref_id", "cmp_id"]
#: Images of a block at least, and pairs of a cell, about, where there are enough.
IMAGE_BLOCK, CELL_PAIRS = 128, 1024


def _nested(features: DataFrame, value: str, order: str | None) -> DataFrame:
    """One row per image: the keys of its features in order and their numbers in a row."""
    numbers = F.col(value)
    key = F.lit(0).cast("long") if order is None else F.col(order).cast("long")
    if not features.schema[value].dataType.typeName() == "array":
        numbers = F.array(numbers)
    return (
        features.filter(F.col(value).isNotNull())
        .groupBy("image_id")
        .agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), numbers.alias("v")))).alias("_f"))
        .select("image_id", F.col("_f.key").alias("keys"), F.flatten("_f.v").alias("numbers"))
    )


def per_pair(
    pairs: DataFrame, features: DataFrame, value: str, match, columns: dict[str, str], order: str | None = None
) -> DataFrame:
    """Rows of ``match(keys1, rows1, keys2, rows2)`` for every pair of images.

    ``match`` gets the features of both sides as matrices, in the order of the column
    ``order``, and gives one array for each of ``columns`` (name: long or double). Pairs
    are dealt to cells of two blocks of images, so an image goes once to each cell in
    which it has a pair. Many pairs are dealt to blocks of ``IMAGE_BLOCK`` images; few ones
    to larger blocks, so that there are as many cells as ``CELL_PAIRS`` need and a cell has
    about two images for each of its pairs at most. A side without features has no keys
    and None for rows. Repeated pairs are matched each.
    """
    images = cut_lineage(_nested(features, value, order))
    blocks = min(images.count() // IMAGE_BLOCK, math.isqrt(pairs.count() // CELL_PAIRS)) + 1

    def block(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).alias(f"_{column}")

    dealt = pairs.select(F.col("ref_id").cast("long"), F.col("cmp_id").cast("long"), block("ref_id"), block("cmp_id"))
    cell = ["_ref_id", "_cmp_id"]
    kind = images.schema["numbers"].dataType.simpleString()
    none = [F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast(kind).alias("numbers")]
    rows = dealt.select(*cell, F.lit(0).alias("side"), "ref_id", "cmp_id", *none)
    for side, own in ((1, "ref_id"), (2, "cmp_id")):
        wanted = dealt.select(*cell, own).distinct()
        held = wanted.join(images, F.col(own) == F.col("image_id"))
        ids = [F.col(own).alias("ref_id"), F.lit(None).cast("long").alias("cmp_id")]
        rows = rows.unionByName(held.select(*cell, F.lit(side).alias("side"), *ids, "keys", "numbers"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        first, second = table.column("ref_id").to_pylist(), table.column("cmp_id").to_pylist()
        sides: list[dict] = [{}, {}, {}]
        for i in np.flatnonzero(side).tolist():
            keys = table.column("keys")[i].values.to_numpy(zero_copy_only=False)
            numbers = table.column("numbers")[i].values.to_numpy(zero_copy_only=False)
            if len(numbers) % len(keys):
                raise ValueError(f"image {first[i]}: features of several lengths")
            sides[side[i]][first[i]] = keys, numbers.reshape(len(keys), -1)
        empty = np.zeros(0, np.int64), None
        parts, sizes, chosen = [], [], np.flatnonzero(side == 0).tolist()
        for i in chosen:
            (kp1, a), (kp2, b) = sides[1].get(first[i], empty), sides[2].get(second[i], empty)
            found = match(kp1, a, kp2, b)
            parts.append(found)
            sizes.append(len(found[0]))
        made = [np.concatenate([p[c] for p in parts]) if parts else [] for c in range(len(columns))]
        at = pa.array(np.repeat(chosen, sizes).astype(np.int64))
        ids = [table.column(c).combine_chunks().take(at) for c in PAIR]
        kinds = [pa.float64() if kind == "double" else pa.int64() for kind in columns.values()]
        return pa.table([*ids, *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], [*PAIR, *columns])

    schema = ", ".join(f"{name} {kind}" for name, kind in {**dict.fromkeys(PAIR, "long"), **columns}.items())
    return rows.groupBy(*cell).applyInArrow(run, schema)
