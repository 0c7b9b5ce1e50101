"""Plausibility report of image pairs from colour histograms and edge features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions.vector import cosine, doubles, sorted_value_distance


def sanity_report(
    pairs: DataFrame,
    histograms: DataFrame,
    edges: DataFrame,
    max_color_distance: float = 0.3,
    min_edge_cosine: float = 0.4,
) -> DataFrame:
    """Gates and similarities per pair; a failed gate warns, it drops nothing.

    A pair of which an image lacks a feature stays, with nulls and a warning.

    ``histograms`` is ``image_id, histogram``; ``edges`` is ``image_id, edge``.
    """
    features = histograms.join(edges, "image_id", "outer").select(
        "image_id", doubles(F.col("histogram")).alias("h"), doubles(F.col("edge")).alias("e")
    )
    first = features.select(F.col("image_id").alias("ref_id"), F.col("h").alias("h1"), F.col("e").alias("e1"))
    second = features.select(F.col("image_id").alias("cmp_id"), F.col("h").alias("h2"), F.col("e").alias("e2"))
    return (
        pairs.select("ref_id", "cmp_id")
        .join(first, "ref_id", "left")
        .join(second, "cmp_id", "left")
        .select(
            "ref_id",
            "cmp_id",
            sorted_value_distance(F.col("h1"), F.col("h2")).alias("color_distance"),
            cosine(F.col("h1"), F.col("h2")).alias("color_similarity"),
            cosine(F.col("e1"), F.col("e2")).alias("edge_similarity"),
        )
        .withColumns(
            {
                "color_compatible": F.col("color_distance") <= max_color_distance,
                "structure_compatible": F.col("edge_similarity") >= min_edge_cosine,
                "discriminative_score": (F.col("color_similarity") + F.col("edge_similarity")) / 2,
            }
        )
        .withColumn("warning", F.coalesce(~(F.col("color_compatible") & F.col("structure_compatible")), F.lit(True)))
    )
