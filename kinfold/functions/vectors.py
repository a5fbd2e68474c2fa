"""Vector arithmetic on array columns with higher-order functions. For all pairs use ``operators.similarity``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(v: Column) -> Column:
    """Components as doubles, with 0 for null, NaN and infinities."""
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.transform(v, lambda x: F.when(F.isnan(number(x)) | (F.abs(number(x)) == float("inf")), F.lit(0.0)).otherwise(number(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
