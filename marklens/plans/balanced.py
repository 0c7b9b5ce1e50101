"""Balanced comparison: fuse detector, template, structure and shape scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions import scoring as S
from marklens.operators import matching as M


def balanced_compare(
    match_counts: DataFrame, template: DataFrame, structure: DataFrame, shapes: DataFrame
) -> DataFrame:
    """One fused 0..0.95 score with confidence per pair that any of the tables holds.

    A pair without observations of a method scores 0 there; without match counts it
    has no best method and counts of 0. Tables dealt by pair alike are not shuffled again.
    """
    # each part has one row per pair, so their union is grouped where joins would shuffle every result again
    parts = [M.best_method(M.method_scores(match_counts))]
    parts += [M.template_score(template), M.ssim_score(structure), M.shape_score(shapes)]
    # a null id meets no other row
    alone = F.coalesce(*[F.when(F.col(c).isNull(), True) for c in M.PAIR])
    parts = [part.withColumn("_alone", F.when(alone, F.lit(i))) for i, part in enumerate(parts)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    keys = [*M.PAIR, "_alone"]
    scored = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])
    scored = scored.fillna(0.0, ["feature_score", "template_score", "ssim_score", "shape_score"])
    scored = scored.fillna(0, ["inlier_matches", "keypoints_img1", "keypoints_img2"])
    inliers = F.col("inlier_matches")
    return (
        scored.withColumn(
            "similarity_score",
            S.fuse_scores(
                F.col("feature_score"),
                F.col("template_score"),
                F.col("ssim_score"),
                F.col("shape_score"),
                inliers,
            ),
        )
        .withColumn("confidence_level", S.confidence_label(F.col("similarity_score")))
        .select(
            *M.PAIR,
            "similarity_score",
            "keypoints_img1",
            "keypoints_img2",
            "inlier_matches",
            "best_method",
            "confidence_level",
        )
    )
