"""k-means palettes of all images at once, over their colour histograms.

An image's histogram is one group, in which numpy runs all Lloyd rounds: one shuffle,
whatever their number. Histograms of over IMAGE_COLORS colours never are one group: they
go through Lloyd rounds as DataFrame steps, where an image's centres are one row of plain
numbers and hash aggregates give the next ones. Both follow the same rules.
Seeds are the most frequent colours, so results are repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.operators.grouping import top_k
from marklens.session import cut_lineage

#: Colours of an image that one group may hold (some 60 bytes each).
IMAGE_COLORS = 1 << 20


def _centre(j: int, i: int) -> str:
    return f"_c{j}_{i}"


def _assigned(colors: DataFrame, centres: DataFrame, space: Sequence[str], k: int) -> DataFrame:
    """Add ``_at``, the nearest centre (from 1, the first one on a tie).

    Plain columns all the way, so distances stay in generated code; a centre an
    image does not have is null and never the nearest.
    """

    def distance(j: int) -> Column:
        gaps = [F.col(c) - F.col(_centre(j, i)) for i, c in enumerate(space)]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    names = [f"_d{j}" for j in range(1, k + 1)]
    measured = (
        colors.join(centres, "image_id")
        .withColumns({name: distance(j) for j, name in enumerate(names, 1)})
        .withColumn("_least", F.least(*names) if k > 1 else F.col(names[0]))
    )
    at = F.when(F.col(names[0]) == F.col("_least"), 1)
    for j, name in enumerate(names[1:], 2):
        at = at.when(F.col(name) == F.col("_least"), j)
    return measured.withColumn("_at", at).drop(*names, "_least")


def kmeans_palette(
    histogram: DataFrame,
    k: int | Column,
    rounds: int = 10,
    space: Sequence[str] = ("r", "g", "b"),
    max_k: int | None = None,
) -> DataFrame:
    """``image_id, slot, x0, x1, x2, n, weight`` per cluster, biggest cluster first.

    ``histogram`` has ``image_id, r, g, b, n`` and the columns of ``space``. ``k``
    may be an expression over ``total`` (weight of the image), bounded by ``max_k``.
    """
    limit = k if isinstance(k, int) else max_k
    if limit is None:
        raise ValueError("max_k is needed when k is an expression")
    wanted = dict.fromkeys(["image_id", "r", "g", "b", "n", *space])
    histogram = cut_lineage(histogram.select(*wanted).filter(F.col("image_id").isNotNull()))
    number = F.lit(k) if isinstance(k, int) else F.least(k.cast("int"), F.lit(limit))
    sizes = histogram.groupBy("image_id").agg(F.sum("n").alias("total"), F.count("*").alias("_colors"))
    sizes = cut_lineage(sizes.select("image_id", number.cast("int").alias("_k"), "_colors").filter("_k >= 1"))
    small, big = sizes.filter(F.col("_colors") <= IMAGE_COLORS), sizes.filter(F.col("_colors") > IMAGE_COLORS)
    clusters = _in_groups(histogram.join(small.drop("_colors"), "image_id"), rounds, space)
    if not big.isEmpty():
        rest = _in_steps(histogram.join(big.drop("_colors"), "image_id"), limit, rounds, space)
        clusters = clusters.unionByName(rest.select(*clusters.columns))
    return clusters


def _in_groups(colors: DataFrame, rounds: int, space: Sequence[str]) -> DataFrame:
    """Clusters of images whose colours (with ``_k``) fit one group."""
    axes = [f"x{i}" for i in range(len(space))]

    def nearest(points: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
        at, least = np.zeros(len(points[0]), np.int64), None
        for j, centre in enumerate(centres):
            gaps = [p - c for p, c in zip(points, centre, strict=True)]
            far = gaps[0] * gaps[0]
            for gap in gaps[1:]:
                far = far + gap * gap
            if least is None:
                least = far
            else:  # the first centre on a tie
                nearer = far < least
                at[nearer], least[nearer] = j, far[nearer]
        return at

    def run(table: pa.Table) -> pa.Table:
        number = lambda name: table.column(name).to_numpy()
        order = np.lexsort((number("b"), number("g"), number("r"), -number("n")))
        n = number("n")[order]
        points = [number(c)[order].astype(np.float64) for c in space]
        centres = np.stack([p[: table.column("_k")[0].as_py()] for p in points], 1)
        for _ in range(rounds):
            at = nearest(points, centres)
            weight = np.bincount(at, n, len(centres))
            held = weight > 0  # a centre without colours stays where it was
            for i, p in enumerate(points):
                centres[held, i] = np.bincount(at, n * p, len(centres))[held] / weight[held]
        size = np.bincount(nearest(points, centres), n, len(centres)).astype(np.int64)
        ranked = [j for j in np.argsort(-size, kind="stable").tolist() if size[j]]
        image = pa.chunked_array([table.column("image_id").combine_chunks().take(pa.array([0] * len(ranked)))])
        return pa.table(
            [
                image, pa.array(range(1, len(ranked) + 1), pa.int32()),
                *[pa.array(centres[ranked, i]) for i in range(len(points))],
                pa.array(size[ranked]), pa.array(size[ranked] / size.sum()),
            ],
            ["image_id", "slot", *axes, "n", "weight"],
        )

    kind = colors.schema["image_id"].dataType.simpleString()
    typed = colors.withColumn("n", F.col("n").cast("long"))
    schema = ", ".join([f"image_id {kind}", "slot int", *[f"{x} double" for x in axes], "n long", "weight double"])
    return typed.groupBy("image_id").applyInArrow(run, schema)


def _in_steps(histogram: DataFrame, limit: int, rounds: int, space: Sequence[str]) -> DataFrame:
    """Clusters by Lloyd rounds as joins and aggregates; ``_k`` is the number wanted."""
    seeds = top_k(
        histogram.select("image_id", "r", "g", "b", "n", *[F.col(c).alias(f"_{c}") for c in space]),
        ["image_id"],
        [F.desc("n"), F.asc("r"), F.asc("g"), F.asc("b")],
        limit,
    )
    centres = seeds.groupBy("image_id").agg(
        *[
            F.max(F.when(F.col("rank") == j, F.col(f"_{c}")).cast("double")).alias(_centre(j, i))
            for j in range(1, limit + 1)
            for i, c in enumerate(space)
        ]
    )
    wanted = histogram.select("image_id", "_k").distinct()
    centres = centres.join(wanted, "image_id").select(
        "image_id",
        *[
            F.when(F.col("_k") >= j, F.col(_centre(j, i))).alias(_centre(j, i))
            for j in range(1, limit + 1)
            for i in range(len(space))
        ],
    )
    colors = histogram.select("image_id", "n", *space)
    centres = cut_lineage(centres)
    for _ in range(rounds):
        centres = cut_lineage(_moved(_assigned(colors, centres, space, limit), centres, space, limit))
    clusters = (
        _assigned(colors, centres, space, limit)
        .groupBy("image_id", F.col("_at").alias("cluster"))
        .agg(F.sum("n").alias("n"))
    )
    totals = clusters.groupBy("image_id").agg(F.sum("n").alias("_total"))
    order = [F.desc("n"), F.asc("cluster")]
    ranked = top_k(clusters, ["image_id"], order, limit, rank="slot")

    def own(i: int) -> Column:
        picked = F.when(F.col("cluster") == 1, F.col(_centre(1, i)))
        for j in range(2, limit + 1):
            picked = picked.when(F.col("cluster") == j, F.col(_centre(j, i)))
        return picked.alias(f"x{i}")

    return (
        ranked.join(totals, "image_id")
        .join(centres, "image_id")
        .select(
            "image_id",
            "slot",
            *[own(i) for i in range(len(space))],
            "n",
            (F.col("n") / F.col("_total")).alias("weight"),
        )
    )


def _moved(assigned: DataFrame, centres: DataFrame, space: Sequence[str], k: int) -> DataFrame:
    """Centres after one round; a centre without colours stays where it was.

    Colours are summed per image and centre first (combined before the shuffle),
    then the few sums of an image become its row of centres.
    """
    axes = range(len(space))
    means = (
        assigned.groupBy("image_id", "_at")
        .agg(F.sum("n").alias("_n"), *[F.sum(F.col("n") * F.col(c)).alias(f"_s{i}") for i, c in enumerate(space)])
        .select("image_id", "_at", *[(F.col(f"_s{i}").cast("double") / F.col("_n")).alias(f"_m{i}") for i in axes])
    )
    names = [(j, i) for j in range(1, k + 1) for i in axes]
    wide = means.groupBy("image_id").agg(
        *[F.max(F.when(F.col("_at") == j, F.col(f"_m{i}"))).alias(f"_new{j}_{i}") for j, i in names]
    )
    return centres.join(wide, "image_id").select(
        "image_id",
        *[F.coalesce(f"_new{j}_{i}", _centre(j, i)).alias(_centre(j, i)) for j, i in names],
    )
