"""Distances between two array columns."""

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    """Sum of an array<double>."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def hamming(a: Column, b: Column) -> Column:
    """Share of positions at which the two arrays differ."""
    differing = F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))
    return F.try_divide(total(differing), F.size(a).cast("double"))
