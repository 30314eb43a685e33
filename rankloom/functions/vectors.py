"""Column functions over dense vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; NULL when either side is NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit_norm(vector: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    length = F.sqrt(dot(vector, vector))
    return F.when(
        length > 0, F.transform(vector, lambda x: x.cast("double") / length)
    ).otherwise(F.transform(vector, lambda x: x.cast("double")))
