"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; that of a zero vector counts as 1."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its length."""
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def blend(a: Column, b: Column, weight: float = 0.3) -> Column:
    """(1 - weight) a + weight b."""
    return F.zip_with(a, b, lambda x, y: x * (1 - weight) + y * weight)


def cosine_or_zero(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """Cosine with a small number against division by zero; 0 for empty vectors and for those of unequal length."""
    root = lambda v: F.sqrt(dot(v, v))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot(a, b) / (root(a) * root(b) + epsilon)).otherwise(0.0)


def sparse(indices: Column, values: Column) -> Column:
    """Array of {term, weight} of two parallel arrays; of a term given twice the last weight, without zeros."""
    pairs = F.arrays_zip(indices.alias("term"), values.alias("weight"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["term"] == p["term"]))
    return F.filter(last, lambda p: p["weight"] != 0)
