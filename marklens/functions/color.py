"""Colour expressions: spaces, distances, similarity curves and families.

Functions that need intermediate values take a DataFrame and add columns in
stages, so that each intermediate is computed once inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB primaries to XYZ (D65), reference white.
RGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
WHITE = (0.95047, 1.0, 1.08883)
# Luminance weights.
LUMA = (0.299, 0.587, 0.114)
# Hue bounds of the colour families (0..179 scale).
FAMILY_HUES = ((35, "orange"), (75, "yellow"), (105, "green"), (135, "cyan"))
# Lower bound and label of the colour risk.
RISK_BANDS = (
    (85, "VERY HIGH RISK"),
    (70, "HIGH RISK"),
    (50, "MODERATE RISK"),
    (30, "LOW RISK"),
    (None, "MINIMAL RISK"),
)


def with_lab(df: DataFrame, r="r", g="g", b="b", prefix="lab_") -> DataFrame:
    """Add ``{prefix}l``, ``{prefix}a``, ``{prefix}b`` for 0..255 channels."""

    def linear(name: str) -> Column:
        c = F.col(name) / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def response(name: str) -> Column:
        t = F.col(name)
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(
            t * 7.787 + 16.0 / 116.0
        )

    lin = {f"_lin{i}": linear(c) for i, c in enumerate((r, g, b))}
    xyz = {
        f"_xyz{i}": sum(
            (F.col(f"_lin{j}") * m for j, m in enumerate(row[1:], 1)), F.col("_lin0") * row[0]
        )
        / WHITE[i]
        for i, row in enumerate(RGB_TO_XYZ)
    }
    out = {f"_f{i}": response(f"_xyz{i}") for i in range(3)}
    return (
        df.withColumns(lin)
        .withColumns(xyz)
        .withColumns(out)
        .withColumns(
            {
                f"{prefix}l": F.col("_f1") * 116.0 - 16.0,
                f"{prefix}a": (F.col("_f0") - F.col("_f1")) * 500.0,
                f"{prefix}b": (F.col("_f1") - F.col("_f2")) * 200.0,
            }
        )
        .drop(*lin, *xyz, *out)
    )


def hue_degrees(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    raw = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, (g - b) / F.nullif(span, F.lit(0)))
        .when(top == g, (b - r) / F.nullif(span, F.lit(0)) + 2.0)
        .otherwise((r - g) / F.nullif(span, F.lit(0)) + 4.0)
    )
    degrees = raw * 60.0
    return F.when(degrees < 0, degrees + 360.0).otherwise(degrees)


def saturation_percent(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0.0)).otherwise((top - low) * 100.0 / F.nullif(top, F.lit(0)))


def value_percent(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) * 100.0 / 255.0


def hue_180(r: Column, g: Column, b: Column) -> Column:
    """Hue on the 8-bit 0..179 scale."""
    return F.pmod(F.floor(hue_degrees(r, g, b) / 2.0 + 0.5), F.lit(180)).cast("int")


def saturation_255(r: Column, g: Column, b: Column) -> Column:
    """Saturation on the 8-bit 0..255 scale."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, F.lit(0)).otherwise(
        F.floor((top - low) * 255.0 / F.nullif(top, F.lit(0)) + 0.5).cast("int")
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def channel_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def channel_std(r: Column, g: Column, b: Column) -> Column:
    """Population deviation of the three channels."""
    mean = channel_mean(r, g, b)
    return F.sqrt(
        ((r - mean) * (r - mean) + (g - mean) * (g - mean) + (b - mean) * (b - mean)) / 3.0
    )


def channel_range(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def distinctiveness(r: Column, g: Column, b: Column) -> Column:
    """0.7 saturation + 0.3 channel deviation / 255."""
    return (
        saturation_percent(r, g, b) / 100.0 * 0.7 + channel_std(r, g, b) / 255.0 * 0.3
    )


def color_family(r: Column, g: Column, b: Column) -> Column:
    hue, sat = hue_180(r, g, b), saturation_255(r, g, b)
    family = F.when(sat < 50, "grayscale").when((hue < 15) | (hue > 165), "red")
    for bound, name in FAMILY_HUES:
        family = family.when(hue < bound, name)
    return family.otherwise("blue")


def rgb_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    dr, dg, db = (x - y for x, y in zip(a, b, strict=True))
    return F.sqrt((dr * dr + dg * dg + db * db).cast("double"))


def _lab(prefix: str) -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}l"), F.col(f"{prefix}a"), F.col(f"{prefix}b")


def with_delta_e76(df: DataFrame, p1: str, p2: str, out: str = "delta_e") -> DataFrame:
    (l1, a1, b1), (l2, a2, b2) = _lab(p1), _lab(p2)
    return df.withColumn(
        out,
        F.sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)),
    )


def with_delta_e94(df: DataFrame, p1: str, p2: str, out: str = "delta_e") -> DataFrame:
    """CIE94 with graphic-arts weights; side 1 is the standard."""
    (l1, a1, b1), (l2, a2, b2) = _lab(p1), _lab(p2)
    c1, c2 = F.col("_c1"), F.col("_c2")
    dc = c1 - c2
    dh2 = F.greatest((a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2) - dc * dc, F.lit(0.0))
    sc, sh = c1 * 0.045 + 1.0, c1 * 0.015 + 1.0
    return (
        df.withColumns({"_c1": F.sqrt(a1 * a1 + b1 * b1), "_c2": F.sqrt(a2 * a2 + b2 * b2)})
        .withColumn(out, F.sqrt((l1 - l2) * (l1 - l2) + (dc / sc) * (dc / sc) + dh2 / (sh * sh)))
        .drop("_c1", "_c2")
    )


def with_delta_e2000(df: DataFrame, p1: str, p2: str, out: str = "delta_e") -> DataFrame:
    """CIEDE2000 (Sharma, Wu, Dalal 2005), unit weights."""
    (l1, a1, b1), (l2, a2, b2) = _lab(p1), _lab(p2)
    c = F.col
    pow7 = 25.0**7

    def hue(a: Column, b: Column) -> Column:
        angle = F.degrees(F.atan2(b, a))
        return (
            F.when((a == 0) & (b == 0), F.lit(0.0))
            .when(angle < 0, angle + 360.0)
            .otherwise(angle)
        )

    def cos_deg(angle: Column) -> Column:
        return F.cos(F.radians(angle))

    stages = [
        {"_cm": (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2.0},
        {"_cm7": F.pow(c("_cm"), F.lit(7.0))},
        {"_g": (F.lit(1.0) - F.sqrt(c("_cm7") / (c("_cm7") + pow7))) * 0.5 + 1.0},
        {"_ap1": a1 * c("_g"), "_ap2": a2 * c("_g")},
        {
            "_cp1": F.sqrt(c("_ap1") * c("_ap1") + b1 * b1),
            "_cp2": F.sqrt(c("_ap2") * c("_ap2") + b2 * b2),
            "_h1": hue(c("_ap1"), b1),
            "_h2": hue(c("_ap2"), b2),
        },
        {
            "_gray": (c("_cp1") * c("_cp2")) == 0,
            "_dh": c("_h2") - c("_h1"),
            "_hs": c("_h1") + c("_h2"),
            "_cpm": (c("_cp1") + c("_cp2")) / 2.0,
            "_lm": (l1 + l2) / 2.0 - 50.0,
        },
        {
            "_dhw": F.when(c("_gray"), F.lit(0.0))
            .when(c("_dh") > 180.0, c("_dh") - 360.0)
            .when(c("_dh") < -180.0, c("_dh") + 360.0)
            .otherwise(c("_dh")),
            "_hm": F.when(c("_gray"), c("_hs"))
            .when(F.abs(c("_dh")) <= 180.0, c("_hs") / 2.0)
            .when(c("_hs") < 360.0, (c("_hs") + 360.0) / 2.0)
            .otherwise((c("_hs") - 360.0) / 2.0),
            "_cpm7": F.pow(c("_cpm"), F.lit(7.0)),
            "_lm2": c("_lm") * c("_lm"),
        },
        {
            "_t": F.lit(1.0)
            - cos_deg(c("_hm") - 30.0) * 0.17
            + cos_deg(c("_hm") * 2.0) * 0.24
            + cos_deg(c("_hm") * 3.0 + 6.0) * 0.32
            - cos_deg(c("_hm") * 4.0 - 63.0) * 0.20,
            "_turn": F.exp(-((c("_hm") - 275.0) / 25.0) * ((c("_hm") - 275.0) / 25.0)) * 60.0,
        },
        {
            "_el": (l2 - l1) / (c("_lm2") * 0.015 / F.sqrt(c("_lm2") + 20.0) + 1.0),
            "_ec": (c("_cp2") - c("_cp1")) / (c("_cpm") * 0.045 + 1.0),
            "_eh": F.sqrt(c("_cp1") * c("_cp2"))
            * 2.0
            * F.sin(F.radians(c("_dhw") / 2.0))
            / (c("_cpm") * c("_t") * 0.015 + 1.0),
            "_rt": F.sqrt(c("_cpm7") / (c("_cpm7") + pow7))
            * -2.0
            * F.sin(F.radians(c("_turn"))),
        },
        {
            out: F.sqrt(
                F.greatest(
                    c("_el") * c("_el")
                    + c("_ec") * c("_ec")
                    + c("_eh") * c("_eh")
                    + c("_rt") * c("_ec") * c("_eh"),
                    F.lit(0.0),
                )
            )
        },
    ]
    scratch = [name for stage in stages for name in stage if name != out]
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*scratch)


DELTA_E = {"de76": with_delta_e76, "de94": with_delta_e94, "de2000": with_delta_e2000}


def strict_curve(d: Column) -> Column:
    return (
        F.when(d <= 1, F.lit(95.0) - d * 5)
        .when(d <= 3, F.lit(90.0) - (d - 1) * 20)
        .when(d <= 6, F.lit(50.0) - (d - 3) * 10)
        .when(d <= 10, F.lit(20.0) - (d - 6) * 4)
        .otherwise(F.greatest(F.lit(0.0), F.lit(4.0) - (d - 10) * 0.5))
    )


def perceptual_curve(d: Column) -> Column:
    return (
        F.when(d <= 1, F.lit(100.0))
        .when(d <= 2, F.lit(95.0) - (d - 1) * 10)
        .when(d <= 5, F.lit(85.0) - (d - 2) * 15)
        .when(d <= 10, F.lit(40.0) - (d - 5) * 6)
        .when(d <= 20, F.lit(10.0) - (d - 10) * 0.8)
        .otherwise(F.lit(0.0))
    )


def lab_curve(d: Column) -> Column:
    return (
        F.when(d <= 2, F.lit(100.0) - d * 5)
        .when(d <= 10, F.lit(90.0) - (d - 2) * 7.5)
        .when(d <= 50, F.lit(30.0) - (d - 10) * 0.75)
        .otherwise(F.lit(0.0))
    )


def rgb_similarity(distance: Column) -> Column:
    return (F.lit(1.0) - distance / (255.0 * math.sqrt(3.0))) * 100


def risk_label(score: Column) -> Column:
    branches = None
    for bound, label in RISK_BANDS:
        if bound is None:
            return branches.otherwise(F.lit(label))
        test = score >= bound
        branches = F.when(test, label) if branches is None else branches.when(test, label)
    return branches
