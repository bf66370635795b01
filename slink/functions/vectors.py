"""Vector expressions on ARRAY columns, computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    return F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector is kept as it is."""
    length = norm(vector)
    return F.when(length == 0, vector.cast("array<double>")).otherwise(
        F.transform(vector.cast("array<double>"), lambda x: x / length)
    )


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left.cast("array<double>"), right.cast("array<double>"), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
