"""Vector algebra on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    size = F.greatest(norm(v), F.lit(eps))
    return F.transform(doubles(v), lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def distance(sim: Column) -> Column:
    """Cosine distance, never below zero."""
    return F.greatest(F.lit(0.0), 1 - sim)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return sigmoid(yes - no)
