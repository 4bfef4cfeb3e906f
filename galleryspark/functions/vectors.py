"""Vector scalar functions on ARRAY columns, built from higher-order functions.

All arithmetic is done in DOUBLE, whatever the element type of the stored vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NORM_FLOOR = 1e-12


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vector), lambda x: x * x)))


def l2_normalize(vector: Column) -> Column:
    """v / max(norm, 1e-12); a zero vector stays zero.

    The norm is an argument and not part of the lambda, where it would be worked out again for every element.
    """
    length = F.greatest(norm(vector), F.lit(NORM_FLOOR))
    return F.zip_with(as_double(vector), F.array_repeat(length, F.size(vector)), lambda x, n: x / n)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    floor = F.lit(NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def similarity_from_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def sim_to_l2(similarity: Column) -> Column:
    """Distance between unit vectors of the given cosine similarity."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * similarity))


def negative_cosine(prediction: Column, target: Column) -> Column:
    """Mean of the negated cosine over the rows of the group (an aggregate)."""
    return F.avg(-cosine_similarity(prediction, target))


def symmetric_loss(p1: Column, p2: Column, z1: Column, z2: Column) -> Column:
    """Half the sum of the two crossed negative cosines (an aggregate)."""
    return F.lit(0.5) * (negative_cosine(p1, z2) + negative_cosine(p2, z1))


def require_dim(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail the job on the first vector whose length differs from the index dimension."""
    size = F.size(vector)
    message = F.concat(F.lit(f"vector dimension must be {dim}, found "), size.cast("string"))
    return df.withColumn(vector, F.when(size == dim, F.col(vector)).otherwise(F.raise_error(message)))
