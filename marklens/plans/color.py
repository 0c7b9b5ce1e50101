"""Colour jobs: palettes from pixels, colour index and colour scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions import color as C
from marklens.operators import palette as P
from marklens.operators import pixels as X
from marklens.operators.kmeans import kmeans_palette
from marklens.operators.knn import knn_join

METHODS = ("weighted_lab", "cosine", "euclidean")


def _whole_rgb(clusters: DataFrame) -> DataFrame:
    """Cluster centres as whole RGB numbers."""
    return clusters.select(
        "image_id",
        F.col("slot").cast("int").alias("slot"),
        *[F.floor(f"x{i}").cast("int").alias(c) for i, c in enumerate("rgb")],
        "weight",
    )


def strict_palette(pixels: DataFrame, n: int = 8, rounds: int = 10) -> DataFrame:
    """Guarded pixels, k-means, light colours pruned, padded to ``n``."""
    hist = X.guarded_filter(X.color_histogram(pixels), "image_id", X.logo_pixel_guards(n))
    return P.prune_palette(_whole_rgb(kmeans_palette(hist, n, rounds)), n)


def perceptual_palette(pixels: DataFrame, n: int = 6, rounds: int = 10) -> DataFrame:
    """k-means in 8-bit LAB, back in RGB, ordered by importance, near colours dropped."""
    hist = C.with_lab(X.color_histogram(pixels)).withColumns(
        {
            "l8": F.col("lab_l") * 255.0 / 100.0,
            "a8": F.col("lab_a") + 128.0,
            "b8": F.col("lab_b") + 128.0,
        }
    )
    hist = X.guarded_filter(hist, "image_id", X.lightness_guard(F.col("l8")))
    clusters = kmeans_palette(hist, n, rounds, space=("l8", "a8", "b8"))
    return P.distinct_palette(_lab8_to_rgb(clusters), n)


def _lab8_to_rgb(clusters: DataFrame) -> DataFrame:
    """Inverse of the 8-bit LAB scale, clipped to whole RGB."""

    def inverse(t):
        return F.when(t > 6.0 / 29.0, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)

    def channel(linear):
        s = F.when(linear <= 0.0031308, linear * 12.92).otherwise(
            F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1.0 / 2.4)) * 1.055 - 0.055
        )
        return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    fy = (F.col("x0") * 100.0 / 255.0 + 16.0) / 116.0
    staged = clusters.withColumns(
        {"_fy": fy, "_fx": fy + (F.col("x1") - 128.0) / 500.0, "_fz": fy - (F.col("x2") - 128.0) / 200.0}
    ).withColumns({f"_v{i}": inverse(F.col(f)) * C.WHITE[i] for i, f in enumerate(("_fx", "_fy", "_fz"))})
    x, y, z = (F.col(f"_v{i}") for i in range(3))
    # XYZ to linear sRGB (D65).
    return staged.select(
        "image_id",
        F.col("slot").cast("int").alias("slot"),
        channel(x * 3.2404542 - y * 1.5371385 - z * 0.4985314).alias("r"),
        channel(y * 1.8760108 - x * 0.9692660 + z * 0.0415560).alias("g"),
        channel(x * 0.0556434 - y * 0.2040259 + z * 1.0572252).alias("b"),
        "weight",
    )


def main_color_palette(pixels: DataFrame, n: int = 3, rounds: int = 10) -> DataFrame:
    """Prominent colours of the colourful pixels; too small images drop out."""
    masked = X.chroma_filter(X.background_mask(pixels))
    clusters = kmeans_palette(
        X.color_histogram(masked),
        F.least(F.lit(n), F.floor(F.col("total") / 100)),
        rounds,
        max_k=n,
    )
    return P.prominent_colors(_whole_rgb(clusters), n)


def scan_palette(
    pixels: DataFrame, max_colors: int = 10, min_share: float = 0.005, rounds: int = 10
) -> DataFrame:
    """Palette for colour scans: non-white logo pixels, coverage of at least 0.5 %."""
    logo = X.non_white(X.background_mask(pixels, low=None))
    k = F.least(F.lit(max_colors), F.greatest(F.lit(2), F.floor(F.col("total") / 1000)))
    clusters = kmeans_palette(X.color_histogram(logo), k, rounds, max_k=max_colors)
    return P.min_coverage(_whole_rgb(clusters), min_share)


def build_color_index(pixels: DataFrame, n: int = 3, rounds: int = 10) -> DataFrame:
    """``image_id, embedding``: 13 numbers for each of the ``n`` main colours."""
    return P.feature_vector(main_color_palette(pixels, n, rounds), n)


def search_color_index(queries: DataFrame, index: DataFrame, k: int, **options) -> DataFrame:
    """Nearest images by squared distance of their colour vectors."""
    return knn_join(queries, index, k, "l2", query_id="image_id", base_id="image_id", **options)


def color_scan(pairs: DataFrame, palette: DataFrame, method: str = "weighted_lab") -> DataFrame:
    """Colour similarity, risk and status of each pair; a missing palette fails the pair."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method == "weighted_lab":
        scored = P.lab_color_score(pairs, palette)
    else:
        scored = P.vector_color_score(pairs, P.lab_vector(palette), method)
    known = palette.select("image_id").distinct()
    ref = known.select(F.col("image_id").alias("ref_id"), F.lit(True).alias("_ref"))
    cmp = known.select(F.col("image_id").alias("cmp_id"), F.lit(True).alias("_cmp"))
    ok = F.col("_ref").isNotNull() & F.col("_cmp").isNotNull()
    return (
        scored.join(ref, "ref_id", "left")
        .join(cmp, "cmp_id", "left")
        .select(
            "ref_id",
            "cmp_id",
            "color_similarity",
            F.when(ok, C.risk_label(F.col("color_similarity")))
            .otherwise("PROCESSING FAILED")
            .alias("risk_assessment"),
            F.lit(method).alias("vector_method"),
            F.when(ok, "Success").otherwise("Failed").alias("processing_status"),
        )
    )


def color_summary(scan: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Comparisons, high-risk matches, successes and the mean of the successes."""
    ok = F.col("processing_status") == "Success"
    return scan.agg(
        F.count("*").alias("total_comparisons"),
        F.count_if(F.col("color_similarity") >= threshold).alias("high_risk_matches"),
        F.count_if(ok).alias("successfully_processed"),
        F.avg(F.when(ok, F.col("color_similarity"))).alias("average_similarity"),
    )
