"""Score blends, fusion rules, flags and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 70.0
# Lower bound and name of the confidence of a 0..1 score.
CONFIDENCE_BANDS = (
    (0.75, "Very High"),
    (0.55, "High"),
    (0.35, "Medium"),
    (0.15, "Low"),
    (None, "Very Low"),
)


def clamp_percent(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def blend_fixed(visual: Column, color: Column) -> Column:
    return visual * 0.7 + color * 0.3


def blend_adaptive(visual: Column, color: Column) -> Column:
    """Colour counts more where it is the stronger signal; colour 0 means unknown."""
    return (
        F.when(color == 0, visual)
        .when(visual < color, color * 0.6 + visual * 0.4)
        .otherwise(visual * 0.75 + color * 0.25)
    )


def final_strict(image: Column, text: Column) -> Column:
    """Lean to the one strong signal when the other is weak, else the mean."""
    return (
        F.when((image >= 75) & (text < 30), image * 0.7 + text * 0.3)
        .when((text >= 75) & (image < 30), image * 0.3 + text * 0.7)
        .otherwise(image * 0.5 + text * 0.5)
    )


def final_indexed(image: Column, text: Column) -> Column:
    """As strict, but a pair without text score is judged by the image alone."""
    return F.when(text == 0, image).otherwise(final_strict(image, text))


def final_visual_text(image: Column, text: Column, text1: Column, text2: Column) -> Column:
    """Image alone where a text is blank; a strong text score weighs 0.8."""
    blank = (F.trim(F.coalesce(text1, F.lit(""))) == "") | (
        F.trim(F.coalesce(text2, F.lit(""))) == ""
    )
    return (
        F.when(blank, image)
        .when(text > 75, text * 0.8 + image * 0.2)
        .otherwise(text * 0.5 + image * 0.5)
    )


def is_infringement(final: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return final >= F.lit(threshold)


def confidence_label(score: Column) -> Column:
    branches = None
    for bound, label in CONFIDENCE_BANDS:
        if bound is None:
            return branches.otherwise(F.lit(label))
        test = score >= bound
        branches = F.when(test, label) if branches is None else branches.when(test, label)
    return branches


def highlight_label(score: Column, threshold: float) -> Column:
    """Row highlight of a report: over the threshold, over 50, or none."""
    return F.when(score >= threshold, "high").when(score >= 50, "medium").otherwise("none")


def card_band(score: Column) -> Column:
    """Band of a result card."""
    return F.when(score >= 70, "high").when(score >= 30, "medium").otherwise("low")


def inlier_score(good: Column, inliers: Column, keypoints1: Column, keypoints2: Column) -> Column:
    """min(1, inliers / 50) with at least 10 good matches and 2 keypoints a side."""
    usable = (good >= 10) & (F.least(keypoints1, keypoints2) >= 2) & inliers.isNotNull()
    return F.when(usable, F.least(F.lit(1.0), inliers / 50.0)).otherwise(F.lit(0.0))


# Fixed values per detector: fewest keypoints, fewest good matches, and the rule
# used when no geometric check was possible (fewest good, divisor, ceiling).
DETECTORS = {
    "SIFT": {"keypoints": 5, "good": 4, "good_scored": 4, "unchecked": (6, 15.0, 0.6)},
    "ORB": {"keypoints": 8, "good": 5, "good_scored": 5, "unchecked": (8, 20.0, 0.7)},
    "AKAZE": {"keypoints": 6, "good": 4, "good_scored": 5, "unchecked": (6, 12.0, 0.65)},
}


def _by_method(method: Column, pick) -> Column:
    branches = None
    for name, rule in DETECTORS.items():
        branch = pick(rule)
        branches = (
            F.when(method == name, branch)
            if branches is None
            else branches.when(method == name, branch)
        )
    return branches


def balanced_feature_score(
    method: Column, good: Column, inliers: Column, keypoints1: Column, keypoints2: Column
) -> Column:
    """0..0.95 score of one detector from its match and inlier counts."""
    fewest_keypoints = _by_method(method, lambda r: F.lit(r["keypoints"]))
    fewest_good = _by_method(method, lambda r: F.lit(r["good"]))
    scored_good = _by_method(method, lambda r: F.lit(r["good_scored"]))
    unchecked = _by_method(
        method,
        lambda r: F.when(
            good >= r["unchecked"][0],
            F.least(F.lit(r["unchecked"][2]), good / r["unchecked"][1]),
        ).otherwise(F.lit(0.0)),
    )
    share = inliers / F.nullif(good, F.lit(0))
    ratio = F.when(share < 0.5, share * 0.8).otherwise(share)
    base = (
        ratio * 0.4
        + F.least(F.lit(1.0), good / 20.0) * 0.35
        + F.least(F.lit(1.0), inliers / 15.0) * 0.25
    )
    trust = (
        F.when((ratio > 0.8) & (inliers > 10), 1.3)
        .when((ratio > 0.7) & (inliers > 8), 1.25)
        .when((ratio > 0.6) & (inliers > 5), 1.2)
        .when((ratio > 0.5) & (inliers > 3), 1.15)
        .when(ratio < 0.4, 0.9)
        .otherwise(1.0)
    )
    mean_keypoints = (keypoints1 + keypoints2) / 2.0
    richness = F.when(mean_keypoints > 150, 1.1).when(mean_keypoints > 100, 1.05).otherwise(1.0)
    scored = F.least(F.lit(0.95), F.greatest(F.lit(0.0), base * trust * richness))
    return (
        F.when(
            (F.least(keypoints1, keypoints2) < fewest_keypoints) | (good < fewest_good),
            F.lit(0.0),
        )
        .when(inliers.isNull(), unchecked)
        .when((good < scored_good) | (inliers < 3), F.lit(0.0))
        .otherwise(scored)
    )


def template_scale_score(match: Column, edge: Column) -> Column:
    """Score of one scale; null where the scale does not count."""
    return F.when(
        match > 0.25,
        F.when(edge > 0.3, match * 0.7 + edge * 0.3).when(match > 0.6, match * 0.9),
    )


def template_calibration(best: Column) -> Column:
    return (
        F.when(best.isNull() | (best < 0.3), F.lit(0.0))
        .when(best < 0.6, (best - 0.3) * 0.5 / 0.3)
        .otherwise((best - 0.6) * 0.45 / 0.4 + 0.5)
    )


def structure_calibration(score: Column) -> Column:
    return F.when(score.isNull() | (score < 0.3), F.lit(0.0)).otherwise(
        F.least(F.lit(0.9), (score - 0.3) / 0.7 * 0.9)
    )


def shape_boost(best: Column) -> Column:
    return (
        F.when(best > 0.6, F.least(F.lit(0.85), best * 1.2))
        .when(best > 0.4, F.least(F.lit(0.7), best * 1.1))
        .otherwise(best)
    )


def fuse_scores(
    feature: Column, template: Column, structure: Column, shape: Column, inliers: Column
) -> Column:
    """Weighted fusion of four method scores with agreement multipliers, 0..0.95."""
    scores = (feature, template, structure, shape)

    def over(bound: float) -> Column:
        return sum(((s > bound).cast("int") for s in scores[1:]), (scores[0] > bound).cast("int"))

    weighted = feature * 0.45 + template * 0.25 + structure * 0.20 + shape * 0.10
    strong, good, weak = over(0.6), over(0.35), over(0.1)
    agreement = (
        F.when(strong >= 2, 1.25)
        .when((strong >= 1) | (good >= 2), 1.15)
        .when((good >= 1) | (weak >= 2), 1.08)
        .otherwise(1.0)
    )
    pairing = (
        F.when((feature > 0.4) & (template > 0.3), 1.12)
        .when((feature > 0.5) & (structure > 0.4), 1.08)
        .otherwise(1.0)
    )
    geometry = F.when(inliers >= 5, 1.1).when(inliers > 0, 1.05).otherwise(1.0)
    return F.least(
        F.lit(0.95), F.greatest(F.lit(0.0), weighted * agreement * pairing * geometry)
    )
