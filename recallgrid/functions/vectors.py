"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def truncate(v: Column, n: int) -> Column:
    """The first n dimensions of a vector whose model orders them by weight, of length 1 again."""
    head = F.slice(v, 1, n)
    return F.transform(head, lambda x: x / F.when(norm(head) == 0, F.lit(1.0)).otherwise(norm(head)))
