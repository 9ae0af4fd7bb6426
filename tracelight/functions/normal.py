"""Deterministic normal scores, so that draws need no random state.

Draw ``i`` of coordinate ``j`` takes the fractional part of
``(i + 1) * sqrt(prime_j)`` (a Kronecker low-discrepancy sequence) through the
inverse normal distribution. A retried task yields the same draws.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the inverse normal.
CENTRE_NUMERATOR = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
CENTRE_DENOMINATOR = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
]
TAIL_NUMERATOR = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
TAIL_DENOMINATOR = [
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
]
TAIL_START = 0.02425


def primes(count: int) -> list[int]:
    """The first ``count`` primes."""
    found: list[int] = []
    candidate = 2
    while len(found) < count:
        if all(candidate % p for p in found):
            found.append(candidate)
        candidate += 1
    return found


def _horner(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly inside (0, 1)."""
    centred = p - 0.5
    square = centred * centred
    centre = _horner(CENTRE_NUMERATOR, square) * centred / _horner(CENTRE_DENOMINATOR, square)

    def tail(q: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.log(q))
        return _horner(TAIL_NUMERATOR, t) / _horner(TAIL_DENOMINATOR, t)

    return (
        F.when(p < TAIL_START, tail(p))
        .when(p > 1 - TAIL_START, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def inverse_normal_array(p: np.ndarray) -> np.ndarray:
    """The same quantile for an array inside a task."""
    centred, low = p - 0.5, np.minimum(p, 1 - p)
    square = centred * centred
    centre = np.polyval(CENTRE_NUMERATOR, square) * centred / np.polyval(CENTRE_DENOMINATOR, square)
    t = np.sqrt(-2.0 * np.log(low))
    tail = np.polyval(TAIL_NUMERATOR, t) / np.polyval(TAIL_DENOMINATOR, t)
    return np.where(low < TAIL_START, np.where(p < 0.5, tail, -tail), centre)


def uniform_score(draw: Column, coordinate: int) -> Column:
    """Low-discrepancy uniform of a draw number, coordinates counted from 0."""
    root = F.sqrt(F.lit(float(primes(coordinate + 1)[-1])))
    product = (draw.cast("double") + 1.0) * root
    return product - F.floor(product)


def normal_score(draw: Column, coordinate: int) -> Column:
    return inverse_normal(uniform_score(draw, coordinate))
