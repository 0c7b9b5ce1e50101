"""Low-dimensional coordinates of vectors for a map of an index."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklens.functions.vector import doubles, l2_norm


def project_vectors(vectors: DataFrame, n: int = 3) -> tuple[DataFrame, list[float]]:
    """Principal coordinates ``pc1..pcn`` and the share of variance of each.

    Zero vectors are dropped; at least two vectors are needed. The sign of a
    coordinate is arbitrary.
    """
    live = (
        vectors.withColumn("embedding", doubles(F.col("embedding")))
        .filter(l2_norm(F.col("embedding")) > 0)
        .withColumn("_raw", array_to_vector("embedding"))
    )
    if live.limit(2).count() < 2:
        raise ValueError("at least two non-zero vectors are needed")
    scaler = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False)
    centred = scaler.fit(live).transform(live)
    model = PCA(k=n, inputCol="_centred", outputCol="_pc").fit(centred)
    projected = model.transform(centred).withColumn("_pc", vector_to_array("_pc"))
    keep = [c for c in vectors.columns if c != "embedding"]
    coordinates = [F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(n)]
    return projected.select(*keep, *coordinates), [float(x) for x in model.explainedVariance]
