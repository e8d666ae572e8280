"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def numbers(df: DataFrame, vector: str) -> Column:
    """A column of vectors as it is if it holds floats, which take half the room of doubles and lose nothing, else as doubles."""
    return F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else doubles(F.col(vector))


def valid_vector(v: Column) -> Column:
    """Neither null nor holding a null."""
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(v: Column) -> Column:
    """Probabilities of logits, shifted by the largest."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(v: Column) -> Column:
    """Place (from 0) of the first largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
