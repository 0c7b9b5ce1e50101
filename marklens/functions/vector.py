"""Array expressions: dot products, norms, padding, histogram distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def normalised(vec: Column, norm: Column) -> Column:
    """Unit length by a norm computed before; the zero vector stays as it is.

    The norm stands beside the numbers, so that it is not computed again for each of them.
    """
    norms = F.array_repeat(F.nullif(norm, F.lit(0.0)), F.size(vec))
    return F.when(norm == 0, vec).otherwise(F.zip_with(vec, norms, lambda x, n: x / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when a side has no length."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))


def fit_length(vec: Column, size: int) -> Column:
    """Cut or zero-pad an array to ``size``."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.slice(F.concat(vec, zeros), 1, size)


def sorted_value_distance(a: Column, b: Column) -> Column:
    """Wasserstein distance of two equally long samples."""
    gaps = F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
