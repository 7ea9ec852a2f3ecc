"""Vector arithmetic in double precision on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_search(query: Column, v: Column, query_norm: Column | None = None) -> Column:
    """The search form: a small term keeps the denominator from zero."""
    return dot(query, v) / ((norm(query) if query_norm is None else query_norm) * norm(v) + F.lit(1e-10))


def cosine_related(a: Column, b: Column) -> Column:
    """The related-notes form: 0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
