"""Encoding of scalar values into arrays and bounded numbers."""

import math

from pyspark.sql import Column, functions as F


def one_hot(index: Column, cardinality) -> Column:
    """0/1 array of the given length; an unknown index gives all zeros."""
    size = F.lit(cardinality) if isinstance(cardinality, int) else cardinality
    return F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.when(i == index, 1).otherwise(0),
    )


def attribute_code(x: Column) -> Column:
    """Sensitive attribute as a non-negative integer."""
    return F.abs(x).cast("int")


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def standardise(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def destandardise(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


# Coefficients of Acklam's rational approximation of the inverse
# normal distribution function (relative error below 1.15e-9).
_CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687,
               138.3577518672690, -30.66479806614716, 2.506628277459239)
_CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866,
               66.80131188771972, -13.28068155288572, 1.0)
_TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
             -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996,
             3.754408661907416, 1.0)
_TAIL_FROM = 0.02425


def _horner(coefficients, x):
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1."""
    centred = p - 0.5
    square = centred * centred
    centre = centred * _horner(_CENTRE_NUM, square) / _horner(_CENTRE_DEN, square)

    def tail(q):
        t = F.sqrt(F.lit(-2.0) * F.log(q))
        return _horner(_TAIL_NUM, t) / _horner(_TAIL_DEN, t)

    return (
        F.when(p < _TAIL_FROM, tail(p))
        .when(p > 1 - _TAIL_FROM, -tail(1 - p))
        .otherwise(centre)
    )


def hash_uniform(*parts) -> Column:
    """Number in (0, 1) that depends only on the given values."""
    h = F.pmod(F.xxhash64(*parts), F.lit(2 ** 53))
    return (h.cast("double") + 0.5) / F.lit(float(2 ** 53))


def hash_normal(*parts) -> Column:
    """Standard normal number that depends only on the given values."""
    u = hash_uniform(*parts, F.lit("radius"))
    v = hash_uniform(*parts, F.lit("angle"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
