"""Variant-by-variant comparison and the consensus score of a pair.

The variants of an image travel together, and a pair is one matrix product of both sides;
only cosines or their statistics leave the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.operators.knn import unit_vectors
from marklens.operators.pairwise import PAIR, per_pair


def variant_join(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """Cosine of every variant of ``ref_id`` with every variant of ``cmp_id``."""

    def match(_, a, __, b):
        return [np.zeros(0) if a is None or b is None else (a @ b.T).ravel()]

    return per_pair(pairs, unit_vectors(variants), "embedding", match, {"cosine": "double"})


def consensus_score(
    pairs: DataFrame, variants: DataFrame, threshold: float = 0.6, min_consensus: int = 3
) -> DataFrame:
    """Largest cosine where enough variants agree, else the median.

    Pairs with an image that has no variant are left out; repeated pairs count once.
    """
    names = ("median_similarity", "mean_similarity", "max_similarity", "consensus_ratio", "vit_score")

    def match(_, a, __, b):
        if a is None or b is None:
            return [np.zeros(0)] * len(names)
        cosines = (a @ b.T).ravel()
        high = int((cosines > threshold).sum())
        median, most = np.median(cosines), cosines.max()
        score = median if high < min_consensus else most
        return [np.array([x]) for x in (median, cosines.mean(), most, high / len(cosines), score)]

    wanted = pairs.select(*PAIR).distinct()
    return per_pair(wanted, unit_vectors(variants), "embedding", match, dict.fromkeys(names, "double"))
