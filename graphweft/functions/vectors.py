"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_nonzero(vector: Column) -> Column:
    """True when some component differs from zero; false for null."""
    return F.coalesce(F.exists(vector, lambda x: x != 0.0), F.lit(False))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    length = norm(vector)
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return F.when(length > 0, F.transform(doubles, lambda x: x / length)).otherwise(doubles)


def zeros(dimension: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dimension)


def cosine(left: Column, right: Column) -> Column:
    dot = F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return dot / (norm(left) * norm(right))
