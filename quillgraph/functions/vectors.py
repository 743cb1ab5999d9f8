"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, guard: float = 0.0) -> Column:
    """Cosine; guard is added to each norm, 0 for null at a zero vector."""
    return F.try_divide(dot(a, b), (norm(a) + guard) * (norm(b) + guard))


def width(a: Column | str, n: int) -> Column:
    """The first n dimensions."""
    return F.slice(a, 1, n)
