"""Local-descriptor matching and per-method pair scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from marklens.functions import scoring as S
from marklens.operators.pairwise import PAIR, per_pair

#: Keypoints of the first side that are compared at once.
KEYPOINT_ROWS = 256
# Order in which equal scores are resolved.
METHOD_ORDER = ("SIFT", "ORB", "AKAZE")
# Weights of the structural score by image size.
SIZE_WEIGHTS = {64: 0.2, 128: 0.6, 256: 0.2}


def _clear_matches(ratio: float):
    def match(kp1, a, kp2, b):
        """Number of keypoints whose nearest is clearly nearer than the second."""
        count = 0
        if len(kp1) and len(kp2) > 1:
            square_a, square_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
            for start in range(0, len(a), KEYPOINT_ROWS):
                block, own = a[start : start + KEYPOINT_ROWS], square_a[start : start + KEYPOINT_ROWS]
                rough = own[:, None] + square_b - 2 * (block @ b.T)
                # the product is inexact, so all that may be among the two nearest are measured
                slack = 1e-9 * (own + square_b.max())
                i, j = np.nonzero(rough <= (np.partition(rough, 1, 1)[:, 1] + slack)[:, None])
                exact = np.linalg.norm(block[i] - b[j], axis=1)
                order = np.lexsort((exact, i))
                begin = np.searchsorted(i, np.arange(len(block)))
                near = exact[order]
                count += int((near[begin] < near[begin + 1] * ratio).sum())
        return [np.array([count], np.int64)]

    return match


def ratio_match(
    pairs: DataFrame, descriptors: DataFrame, ratio: float = 0.75, ceiling: int | None = None
) -> DataFrame:
    """Keypoints whose nearest neighbour is clearly nearer than the second.

    One matrix product per pair; only the count leaves the task. All are counted, unless
    a ``ceiling`` is asked for. A pair with a missing side, or with one keypoint on the
    second, has none. Descriptors are unique by ``image_id, kp_id``, finite and of one
    length; null ones are no keypoints.
    """
    plain = descriptors.withColumn("descriptor", F.col("descriptor").cast("array<double>"))
    counted = per_pair(pairs, plain, "descriptor", _clear_matches(ratio), {"good_matches": "long"}, order="kp_id")
    if ceiling is not None:
        counted = counted.withColumn("good_matches", F.least("good_matches", F.lit(ceiling).cast("long")))
    return counted


def _mutual_nearest(max_distance: int):
    def match(kp1, a, kp2, b):
        """Keypoints and distance of the pairs that are nearest from both sides."""
        if not len(kp1) or not len(kp2):
            return [np.zeros(0, np.int64)] * 3
        if a.shape[1] != b.shape[1]:
            raise ValueError("codes of several lengths")
        forward = np.zeros(len(a), np.int64)
        best, back = np.full(len(b), np.iinfo(np.int64).max), np.zeros(len(b), np.int64)
        for start in range(0, len(a), KEYPOINT_ROWS):
            block = a[start : start + KEYPOINT_ROWS]
            apart = np.zeros((len(block), len(b)), np.int64)
            for word in range(b.shape[1]):
                apart += np.bitwise_count((block[:, word, None] ^ b[:, word]).view(np.uint64))
            forward[start : start + len(block)] = apart.argmin(1)  # the first of equals
            row = apart.argmin(0)
            least = apart[row, np.arange(len(b))]
            nearer = least < best
            best[nearer], back[nearer] = least[nearer], row[nearer] + start
        own = np.arange(len(a))
        kept = (back[forward] == own) & (best[forward] < max_distance)
        return [kp1[kept], kp2[forward[kept]], best[forward[kept]]]

    return match


def mutual_match(pairs: DataFrame, codes: DataFrame, max_distance: int = 40) -> DataFrame:
    """Keypoints that are each other's nearest by Hamming distance, under a bound.

    A ``code`` is a bigint, or an array of bigints for wider codes. Equal distances go to
    the smaller ``kp_id``. Only matches leave the task.
    """
    found = per_pair(pairs, codes, "code", _mutual_nearest(max_distance), dict.fromkeys(("kp1", "kp2", "distance"), "long"), order="kp_id")
    number = codes.schema["kp_id"].dataType
    return found.select(
        *PAIR, F.col("kp1").cast(number), F.col("kp2").cast(number), F.col("distance").cast("int")
    )


def method_scores(match_counts: DataFrame) -> DataFrame:
    """Score of every detector of a pair from its match counts."""
    return match_counts.withColumn(
        "score",
        S.balanced_feature_score(*[F.col(c) for c in ("method", "good_matches", "inliers", "kp1", "kp2")]),
    )


def _tie_order(method: Column) -> Column:
    order = F.lit(len(METHOD_ORDER))
    for i, name in enumerate(METHOD_ORDER):
        order = F.when(method == name, i).otherwise(order)
    return order


def best_method(scores: DataFrame) -> DataFrame:
    """Best detector of each pair with its score and counts."""
    # one struct, compared field by field: equal scores of a method go to the larger counts
    best = F.max(F.struct("score", (-_tie_order(F.col("method"))).alias("order"), "method", "inliers", "kp1", "kp2"))
    return (
        scores.groupBy(*PAIR)
        .agg(best.alias("b"))
        .select(
            *PAIR,
            F.col("b.method").alias("best_method"),
            F.col("b.score").alias("feature_score"),
            F.col("b.inliers").alias("inlier_matches"),
            F.col("b.kp1").alias("keypoints_img1"),
            F.col("b.kp2").alias("keypoints_img2"),
        )
    )


def template_score(observations: DataFrame) -> DataFrame:
    """Calibrated best template correlation over scales (``mv``, edge ``em``)."""
    best = F.max(S.template_scale_score(F.col("mv"), F.col("em")))
    return (
        observations.groupBy(*PAIR)
        .agg(best.alias("_best"))
        .select(*PAIR, S.template_calibration(F.col("_best")).alias("template_score"))
    )


def ssim_score(observations: DataFrame, weights: dict[int, float] = SIZE_WEIGHTS) -> DataFrame:
    """Calibrated structural score over image sizes (``size``, ``mv``).

    Exactly the sizes of ``weights`` give their weighted sum, any others the plain mean.
    """
    value = F.greatest(F.lit(0.0), F.col("mv"))
    weight = F.lit(0.0)
    for size, share in weights.items():
        weight = F.when(F.col("size") == size, share).otherwise(weight)
    known = F.coalesce(F.col("size").isin(*weights), F.lit(False))
    # one flag per size, where a distinct count would shuffle the observations once more
    flags = {f"_has{i}": F.bool_or(F.col("size") == size) for i, size in enumerate(weights)}
    whole = F.col("_known")
    for flag in flags:
        whole = whole & F.col(flag)
    return (
        observations.filter(F.col("mv").isNotNull())
        .groupBy(*PAIR)
        .agg(
            F.bool_and(known).alias("_known"),
            F.sum(value * weight).alias("_weighted"),
            F.avg(value).alias("_mean"),
            *[found.alias(flag) for flag, found in flags.items()],
        )
        .select(
            *PAIR,
            S.structure_calibration(F.when(whole, F.col("_weighted")).otherwise(F.col("_mean"))).alias("ssim_score"),
        )
    )


def shape_score(contours: DataFrame, top: int = 3) -> DataFrame:
    """Best agreement among the largest contours of both sides.

    ``contours`` holds one row per pair of contours: ids ``c1, c2``, areas
    ``area1, area2`` and the distances ``hu`` and ``shape`` (null when unknown).
    """
    def area(side: str) -> Column:
        own = F.col(f"area{side}")
        return F.nanvl(own, F.lit(float("inf"))) if isinstance(contours.schema[f"area{side}"].dataType, (FloatType, DoubleType)) else own

    def largest(side: str) -> Column:
        keys = F.transform("_rows", lambda x: F.struct(x[f"area{side}"].isNull(), -x[f"area{side}"], x[f"c{side}"].alias("c")))
        return F.transform(F.slice(F.sort_array(F.array_distinct(keys)), 1, top), lambda x: x["c"])

    parts = [
        F.lit(1.0) / (F.col("hu") + 1.0),
        F.lit(1.0) / (F.col("shape") + 1.0),
        F.least("area1", "area2") / F.nullif(F.greatest("area1", "area2"), F.lit(0.0)),
    ]
    total, known = F.lit(0.0), F.lit(0)
    for part in parts:
        total, known = total + F.coalesce(part, F.lit(0.0)), known + part.isNotNull().cast("int")
    # the contours of a pair are few, so a pair is one row and the table is grouped once
    entry = F.struct("c1", "c2", area("1").alias("area1"), area("2").alias("area2"), (total / F.nullif(known, F.lit(0))).alias("mean"))
    pairs = contours.groupBy(*PAIR).agg(F.collect_list(entry).alias("_rows"))

    def means(kept: Column) -> Column:
        return F.transform(kept, lambda x: x["mean"])

    # each step is the element of a list of one, which is worked out once for all rows of the pair
    ranked = F.transform(
        F.array(F.struct(largest("1").alias("l1"), largest("2").alias("l2"))),
        lambda l: means(F.filter("_rows", lambda x: F.array_contains(l["l1"], x["c1"]) & F.array_contains(l["l2"], x["c2"]))),
    )
    # a pair of few rows has no more contours than are kept
    every = F.array(means(F.filter("_rows", lambda x: x["c1"].isNotNull() & x["c2"].isNotNull())))
    kept = F.when(F.size("_rows") <= top, every).otherwise(ranked)
    best = F.transform(F.filter(kept, lambda x: F.size(x) > 0), F.array_max)
    return pairs.select(*PAIR, F.explode(best).alias("_best")).select(
        *PAIR, F.coalesce(S.shape_boost(F.col("_best")), F.lit(0.0)).alias("shape_score")
    )
