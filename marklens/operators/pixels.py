"""Pixel filters and colour histograms.

Work starts from the colour histogram of an image: equal pixels collapse before
the shuffle, so even an image that holds a third of all pixels leaves at most
one row per colour and input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklens.functions import color as C
from marklens.operators.grouping import top_k

RGB = ("r", "g", "b")
HIST_BINS = 50
# Channels of the 8-bit HSV histogram and their ranges.
HSV_RANGES = (("h", 180), ("s", 256), ("v", 256))


def _rgb() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) for c in RGB)


def color_histogram(pixels: DataFrame) -> DataFrame:
    """``image_id, r, g, b, n`` of a pixel table."""
    return pixels.groupBy("image_id", *RGB).agg(F.count("*").alias("n"))


def dominant_colors(pixels: DataFrame, n: int = 5, step: int = 32) -> DataFrame:
    """Most frequent colours after flooring each channel to ``step``."""
    floored = pixels.select(
        "image_id", *[(F.floor(F.col(c) / step) * step).cast("int").alias(c) for c in RGB]
    )
    order = [F.desc("n"), *[F.asc(c) for c in RGB]]
    return top_k(color_histogram(floored), ["image_id"], order, n, rank="slot")


def alpha_mask(pixels: DataFrame, threshold: int = 100) -> DataFrame:
    return pixels.filter(F.col("a") > threshold)


def background_mask(pixels: DataFrame, low: float | None = 15, high: float = 240) -> DataFrame:
    """Drop near-white and (with ``low``) near-black pixels by luminance.

    ``low=None`` is the one-sided variant that keeps only luminance below ``high``.
    """
    gray = C.luminance(*_rgb())
    return pixels.filter(gray < high) if low is None else pixels.filter(gray.between(low, high))


def chroma_filter(pixels: DataFrame) -> DataFrame:
    """Colourful pixels: channel range over 30, mean within 25..230, deviation over 10."""
    rgb = _rgb()
    mean = C.channel_mean(*rgb)
    return pixels.filter(
        (C.channel_range(*rgb) > 30) & (mean > 25) & (mean < 230) & (C.channel_std(*rgb) > 10)
    )


def non_white(pixels: DataFrame) -> DataFrame:
    return pixels.filter(F.least(*_rgb()) < 230)


Guard = tuple[Column, float | None, float | None]


def guarded_filter(
    df: DataFrame, key: str, guards: Sequence[Guard], weight: str = "n"
) -> DataFrame:
    """Apply filters in order, each only where enough weight of the key survives.

    A guard is ``(predicate, min_weight, min_share)``; it filters a key when the
    surviving weight is over ``min_weight`` or over ``min_share`` of what is left.
    The weight under every combination of earlier guards comes from one
    aggregate, so any number of guards costs one shuffle and one join.
    """
    subsets = [c for r in range(len(guards) + 1) for c in combinations(range(len(guards)), r)]

    def name(subset: Sequence[int]) -> str:
        return "_w" + "".join(str(i) for i in subset)

    def total(subset: Sequence[int]) -> Column:
        kept = F.lit(True)
        for i in subset:
            kept = kept & guards[i][0]
        return F.sum(F.when(kept, F.col(weight)).otherwise(0)).alias(name(subset))

    stats = df.groupBy(key).agg(*[total(s) for s in subsets])
    # decide guard by guard which filters the key gets
    for i, (_, min_weight, min_share) in enumerate(guards):
        decision = F.lit(False)
        for subset in (s for s in subsets if all(j < i for j in s)):
            active = F.lit(True)
            for j in range(i):
                active = active & (F.col(f"_on{j}") if j in subset else ~F.col(f"_on{j}"))
            left, before = F.col(name((*subset, i))), F.col(name(subset))
            enough = left > min_weight if min_share is None else left > before * min_share
            decision = decision | (active & enough)
        stats = stats.withColumn(f"_on{i}", decision)
    flags = [f"_on{i}" for i in range(len(guards))]
    keep = F.lit(True)
    for flag, (predicate, _, _) in zip(flags, guards, strict=True):
        keep = keep & (predicate | ~F.col(flag))
    return df.join(stats.select(key, *flags), key).filter(keep).select(*df.columns)


def logo_pixel_guards(n_colors: int = 8) -> list[Guard]:
    """Background and noise guards before a strict palette is taken."""
    rgb = _rgb()
    bright = rgb[0] + rgb[1] + rgb[2]
    vivid = (C.saturation_255(*rgb) > 40) & (F.greatest(*rgb) > 50)
    return [
        ((bright > 50) & (bright < 700), n_colors * 15, None),
        (vivid, n_colors * 8, None),
        (C.channel_std(*rgb) > 15, n_colors * 5, None),
    ]


def lightness_guard(lightness: Column) -> list[Guard]:
    """Drop extreme 8-bit lightness where over 30 % of the pixels remain."""
    return [((lightness > 10) & (lightness < 240), None, 0.3)]


def hsv_histogram(pixels: DataFrame) -> DataFrame:
    """``image_id, channel, bin, share``: three 50-bin histograms, each summing to 1."""
    rgb = _rgb()
    values = {"h": C.hue_180(*rgb), "s": C.saturation_255(*rgb), "v": F.greatest(*rgb)}
    bins = F.array(
        *[
            F.struct(
                F.lit(channel).alias("channel"),
                F.floor(values[channel] * HIST_BINS / F.lit(limit)).cast("int").alias("bin"),
            )
            for channel, limit in HSV_RANGES
        ]
    )
    counted = (
        color_histogram(pixels)
        .select("image_id", "n", F.explode(bins).alias("x"))
        .groupBy("image_id", "x.channel", "x.bin")
        .agg(F.sum("n").alias("n"))
    )
    # at most 50 rows per image and channel
    total = F.sum("n").over(Window.partitionBy("image_id", "channel"))
    return counted.select("image_id", "channel", "bin", (F.col("n") / total).alias("share"))


def histogram_vector(histogram: DataFrame) -> DataFrame:
    """The three histograms of an image as one array of 150 shares."""
    offset = F.when(F.col("channel") == "h", 0).when(F.col("channel") == "s", HIST_BINS)
    slot = offset.otherwise(2 * HIST_BINS) + F.col("bin")
    filled = F.map_from_entries(F.collect_list(F.struct(slot, F.col("share"))))
    return (
        histogram.groupBy("image_id")
        .agg(filled.alias("_m"))
        .select(
            "image_id",
            F.transform(
                F.sequence(F.lit(0), F.lit(3 * HIST_BINS - 1)),
                lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)),
            ).alias("histogram"),
        )
    )
