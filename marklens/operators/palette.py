"""Palettes: pruning, padding, ordering, vectors and pair scores.

A palette is ``image_id, slot, r, g, b, weight`` with a handful of slots per
image, so per-image windows and arrays stay tiny.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions import color as C
from marklens.functions.color_arrays import DELTA_E
from marklens.functions.scoring import clamp_percent
from marklens.functions.vector import cosine, euclidean, fit_length, l2_norm
from marklens.session import spread

_FIELDS = ("slot", "r", "g", "b", "weight")
_LAB = ("lab_l", "lab_a", "lab_b")


def prune_palette(
    palette: DataFrame, n: int = 8, min_weight: float = 0.03, min_colors: int = 3
) -> DataFrame:
    """Drop light colours where enough others remain, renormalise, pad to ``n``."""
    image = Window.partitionBy("image_id")
    heavy = F.col("weight") > min_weight
    kept = (
        palette.withColumn("_heavy", F.count_if(heavy).over(image))
        .filter(heavy | (F.col("_heavy") < min_colors))
        .withColumn(
            "weight",
            F.when(
                F.col("_heavy") >= min_colors, F.col("weight") / F.sum("weight").over(image)
            ).otherwise(F.col("weight")),
        )
    )
    return pad_palette(kept, n)


def min_coverage(palette: DataFrame, share: float) -> DataFrame:
    """Colours that cover at least ``share`` of the image."""
    return palette.filter(F.col("weight") >= share)


def nest_palette(palette: DataFrame, pad_to: int | None = None) -> DataFrame:
    """``image_id, colors`` with the slots as one array, black slots added up to ``pad_to``."""
    nested = palette.groupBy("image_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("slot").cast("int").alias("slot"),
                    *[F.col(c).cast("int").alias(c) for c in "rgb"],
                    F.col("weight").cast("double").alias("weight"),
                )
            )
        ).alias("colors")
    )
    if pad_to is None:
        return nested
    blank = F.struct(
        F.lit(0).alias("slot"), *[F.lit(0).alias(c) for c in "rgb"], F.lit(0.0).alias("weight")
    )
    padded = F.slice(F.concat("colors", F.array_repeat(blank, pad_to)), 1, pad_to)
    numbered = F.transform(padded, lambda c, i: c.withField("slot", (i + 1).cast("int")))
    return nested.select("image_id", numbered.alias("colors"))


def pad_palette(palette: DataFrame, n: int) -> DataFrame:
    return nest_palette(palette, n).select("image_id", F.inline("colors"))


def distinct_palette(palette: DataFrame, n: int = 6, min_distance: float = 30.0) -> DataFrame:
    """Order colours by importance and drop those too close to a kept one.

    Importance is 0.7 weight + 0.3 mean RGB distance to the other colours. The
    result is padded to ``n`` and its weights sum to 1.
    """

    def gap(a: Column, b: Column) -> Column:
        return C.rgb_distance((a["r"], a["g"], a["b"]), (b["r"], b["g"], b["b"]))

    def importance(color: Column) -> Column:
        spread = F.aggregate("colors", F.lit(0.0), lambda acc, other: acc + gap(color, other))
        return color["weight"] * 0.7 + spread / F.size("colors") * 0.3

    ranked = F.sort_array(
        F.transform(
            "colors",
            lambda c: F.struct(
                (-importance(c)).alias("key"), c["slot"].alias("slot"), c.alias("color")
            ),
        )
    )
    kept = F.aggregate(
        "ranked",
        F.slice(F.transform("ranked", lambda x: x["color"]), 1, 1),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: gap(k, x["color"]) < min_distance) | (F.size(acc) >= n), acc
        ).otherwise(F.concat(acc, F.array(x["color"]))),
    )
    total = F.aggregate("kept", F.lit(0.0), lambda acc, c: acc + c["weight"])
    flat = (
        nest_palette(palette)
        .withColumn("ranked", ranked)
        .withColumn("kept", kept)
        .withColumn("total", total)
        .select("image_id", "total", F.posexplode("kept").alias("_i", "c"))
        .select(
            "image_id",
            (F.col("_i") + 1).alias("slot"),
            "c.r",
            "c.g",
            "c.b",
            F.when(F.col("total") > 0, F.col("c.weight") / F.nullif("total", F.lit(0.0)))
            .otherwise(F.col("c.weight"))
            .alias("weight"),
        )
    )
    return pad_palette(flat, n)


def prominent_colors(palette: DataFrame, n: int = 3, min_share: float = 0.05) -> DataFrame:
    """Colours with enough coverage, ranked by percentage times distinctiveness."""
    rgb = tuple(F.col(c) for c in "rgb")
    scored = C.with_lab(
        min_coverage(palette, min_share).withColumns(
            {
                "percentage": F.col("weight") * 100,
                "hue": C.hue_degrees(*rgb),
                "saturation": C.saturation_percent(*rgb),
                "brightness": C.value_percent(*rgb),
                "distinctiveness": C.distinctiveness(*rgb),
            }
        )
    ).withColumn("prominence", F.col("percentage") * F.col("distinctiveness"))
    order = Window.partitionBy("image_id").orderBy(F.desc("prominence"), F.asc("slot"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def feature_vector(prominent: DataFrame, n: int = 3) -> DataFrame:
    """``image_id, embedding``: 13 numbers per prominent colour, zero-padded."""
    numbers = F.array(
        *[F.col(c) / 255.0 for c in "rgb"],
        F.col("lab_l") / 100.0,
        F.col("lab_a") / 127.0,
        F.col("lab_b") / 127.0,
        F.col("hue") / 360.0,
        F.col("saturation") / 100.0,
        F.col("brightness") / 100.0,
        F.col("percentage") / 100.0,
        F.col("prominence") / 100.0,
        F.col("distinctiveness"),
        F.lit(1.0),
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), numbers.alias("v"))))
    return prominent.groupBy("image_id").agg(
        fit_length(F.flatten(F.transform(ordered, lambda x: x["v"])), n * 13).alias("embedding")
    )


def lab_vector(palette: DataFrame, n: int = 10) -> DataFrame:
    """``image_id, embedding``: L, a, b and percentage per colour, biggest first."""
    numbers = F.array("lab_l", "lab_a", "lab_b", F.col("weight") * 100)
    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("slot"), numbers.alias("v")))
    )
    return (
        C.with_lab(palette)
        .groupBy("image_id")
        .agg(fit_length(F.flatten(F.transform(ordered, lambda x: x["v"])), n * 4).alias("embedding"))
    )


# --- pair scores -------------------------------------------------------------


def _sides(pairs: DataFrame, palette: DataFrame, pad_to: int | None) -> DataFrame:
    """Pairs with the colour arrays of both sides (a missing palette is empty).

    LAB is taken once per palette colour, before the pairs multiply it. Pairs are
    spread by their key, as they are small now and costly to compare.
    """
    flat = pad_palette(palette, pad_to) if pad_to is not None else palette
    fields = [F.col(f).cast("int").alias(f) for f in _FIELDS[:4]]
    entry = F.struct(*fields, "weight", "lab_l", "lab_a", "lab_b")
    nested = (
        C.with_lab(flat).groupBy("image_id").agg(F.sort_array(F.collect_list(entry)).alias("colors"))
    )
    first = nested.select(F.col("image_id").alias("ref_id"), F.col("colors").alias("_c1"))
    second = nested.select(F.col("image_id").alias("cmp_id"), F.col("colors").alias("_c2"))
    joined = (
        pairs.select("ref_id", "cmp_id").join(first, "ref_id", "left").join(second, "cmp_id", "left")
    )
    return spread(joined, "ref_id", "cmp_id")


def _nearest(sides: DataFrame, fields: Sequence[str], distance: Callable) -> DataFrame:
    """Pairs with ``near``: per first-side colour its weight ``w`` and least distance ``d``.

    All colours of a pair are compared inside the row, in Arrow batches. ``near`` is
    empty when a side has no colour.
    """

    def columns(side: pa.ListArray, names: Sequence[str]) -> np.ndarray:
        flat = side.flatten()
        return np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], 1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                first, second = rows.column("_c1"), rows.column("_c2")
                n1, n2 = (pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64) for c in (first, second))
                n1 = np.where(n2 > 0, n1, 0)
                # colours of the first side that have a partner, and where those begin
                has = np.repeat(n1 > 0, pc.fill_null(pc.list_value_length(first), 0).to_numpy())
                x, weight = columns(first, fields)[has], columns(first, ["weight"])[has, 0]
                y, many = columns(second, fields), np.repeat(n2, n1)
                start = np.cumsum(many) - many
                inside = np.arange(many.sum()) - np.repeat(start, many)
                other = np.repeat(np.repeat(np.cumsum(n2) - n2, n1), many) + inside
                gap = distance(np.repeat(x, many, 0), y[other])
                least = np.minimum.reduceat(gap, start) if len(start) else gap
                near = pa.StructArray.from_arrays([pa.array(weight), pa.array(least)], ["w", "d"])
                offsets = pa.array(np.append(0, np.cumsum(n1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("ref_id"), rows.column("cmp_id"), pa.ListArray.from_arrays(offsets, near)],
                    ["ref_id", "cmp_id", "near"],
                )

    ids = ", ".join(f"{n} {sides.schema[n].dataType.simpleString()}" for n in ("ref_id", "cmp_id"))
    return sides.mapInArrow(run, f"{ids}, near array<struct<w: double, d: double>>")


def _total(near: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(near, value), F.lit(0.0), lambda a, x: a + x)


def _weighted(near: Column, value: Callable[[Column], Column]) -> Column:
    """Mean of ``value`` of the least distances by weight, null without colours."""
    mean = _total(near, lambda x: value(x["d"]) * x["w"]) / F.nullif(_total(near, lambda x: x["w"]), F.lit(0.0))
    return F.when(F.size(near) > 0, mean)


def _rgb_gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def family_overlap(pairs: DataFrame, palette: DataFrame, min_weight: float = 0.05) -> DataFrame:
    """Shared weight of the colour families of both sides."""
    families = (
        palette.filter(F.col("weight") > min_weight)
        .groupBy("image_id", C.color_family(F.col("r"), F.col("g"), F.col("b")).alias("family"))
        .agg(F.sum("weight").alias("w"))
    )
    # at most seven families per image
    sets = families.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("family", "w"))).alias("m")
    )
    first = sets.select(F.col("image_id").alias("ref_id"), F.col("m").alias("_m1"))
    second = sets.select(F.col("image_id").alias("cmp_id"), F.col("m").alias("_m2"))
    empty = F.create_map().cast("map<string,double>")
    merged = F.map_zip_with(
        F.coalesce("_m1", empty),
        F.coalesce("_m2", empty),
        lambda _, a, b: F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))),
    )
    return (
        pairs.select("ref_id", "cmp_id")
        .join(first, "ref_id", "left")
        .join(second, "cmp_id", "left")
        .select(
            "ref_id",
            "cmp_id",
            F.aggregate(
                F.array_sort(F.map_values(merged)), F.lit(0.0), lambda acc, x: acc + x
            ).alias("family_overlap"),
        )
    )


def strict_color_score(
    pairs: DataFrame, palette: DataFrame, metric: str = "de2000", slots: int = 8
) -> DataFrame:
    """Strict palette similarity with a penalty for different colour families."""
    keys = ["ref_id", "cmp_id"]
    near = _nearest(_sides(pairs, palette, slots), _LAB, DELTA_E[metric])
    heavy = F.filter("near", lambda x: x["w"] >= 0.05)
    means = near.select(*keys, _weighted(heavy, lambda d: d).alias("_mean")).dropDuplicates(keys)
    overlap = family_overlap(pairs, palette)
    penalty = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("family_overlap") * 2)
    raw = C.strict_curve(F.coalesce("_mean", F.lit(100.0)))
    return (
        overlap.join(means, keys, "left")
        .withColumn("color_similarity", clamp_percent(raw * (F.lit(1.0) - penalty)))
        .select(*keys, "color_similarity")
    )


def perceptual_color_score(
    pairs: DataFrame, palette: DataFrame, metric: str = "de2000"
) -> DataFrame:
    """Weighted best colour similarity; 0 when a side has no usable colour."""
    usable = (F.col("weight") > 0.01) & (F.greatest("r", "g", "b") > 0)
    near = _nearest(_sides(pairs, palette.filter(usable), None), _LAB, DELTA_E[metric])
    # the curve never rises, so the nearest colour is the most similar one
    score = F.coalesce(_weighted(F.col("near"), C.perceptual_curve), F.lit(0.0))
    return near.select("ref_id", "cmp_id", score.alias("color_similarity"))


def lab_color_score(pairs: DataFrame, palette: DataFrame, metric: str = "de94") -> DataFrame:
    """Coverage-weighted closeness of the nearest colours in LAB."""
    near = _nearest(_sides(pairs, palette.filter(F.col("weight") > 0), None), _LAB, DELTA_E[metric])
    score = F.coalesce(_weighted(F.col("near"), C.lab_curve), F.lit(0.0))
    return near.select("ref_id", "cmp_id", score.alias("color_similarity"))


def rgb_color_score(pairs: DataFrame, palette: DataFrame, slots: int = 5) -> DataFrame:
    """1 - mean nearest RGB distance over the padded palettes, in percent."""
    near = _nearest(_sides(pairs, palette, slots), ("r", "g", "b"), _rgb_gap)
    mean = _total(F.col("near"), lambda x: x["d"]) / F.nullif(F.size("near"), F.lit(0))
    score = F.coalesce(C.rgb_similarity(mean), F.lit(0.0))
    return near.select("ref_id", "cmp_id", score.alias("color_similarity"))


def vector_color_score(pairs: DataFrame, vectors: DataFrame, method: str) -> DataFrame:
    """Cosine or Euclidean similarity of palette vectors, in percent."""
    if method not in ("cosine", "euclidean"):
        raise ValueError(f"unknown method: {method}")
    first = vectors.select(F.col("image_id").alias("ref_id"), F.col("embedding").alias("_v1"))
    second = vectors.select(F.col("image_id").alias("cmp_id"), F.col("embedding").alias("_v2"))
    a, b = F.col("_v1"), F.col("_v2")
    if method == "cosine":
        score = F.greatest(F.lit(0.0), cosine(a, b) * 100)
    else:
        reach = l2_norm(a) + l2_norm(b)
        score = F.when(reach == 0, F.lit(0.0)).otherwise(
            F.greatest(
                F.lit(0.0),
                (F.lit(1.0) - euclidean(a, b) / F.nullif(reach, F.lit(0.0))) * 100,
            )
        )
    return (
        pairs.select("ref_id", "cmp_id")
        .join(first, "ref_id", "left")
        .join(second, "cmp_id", "left")
        .select("ref_id", "cmp_id", F.coalesce(score, F.lit(0.0)).alias("color_similarity"))
    )
