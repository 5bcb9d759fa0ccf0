"""Models of the interferometric phase, and coherence of observations against them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(factor: float, feature: Column, value: Column | float) -> Column:
    """A term in proportion to a feature, such as time or baseline."""
    return factor * value * feature


def seasonal(factor: float, time: Column, value: Column | float, origin: Column | float = 0.0, period: float = 1.0) -> Column:
    """A yearly swing: a sine of given period from an origin in time."""
    return factor * value * F.sin(2 * math.pi * (time - origin) / period)


def compound(*terms: Column) -> Column:
    return sum(terms[1:], terms[0])


def symmetric(reach: float, n: int) -> list[float]:
    """``n`` test values from -reach to reach."""
    return [reach * (2 * k / (n - 1) - 1) for k in range(n)] if n > 1 else [0.0]


def coherence(phi: Column, model: Column | float, weight: Column | float = 1.0) -> Column:
    """Aggregate: length of the weighted mean of unit phasors; null and NaN phases weigh 0, and of nothing it is null."""
    known = phi.isNotNull() & ~F.isnan(phi)
    w = F.when(known, F.lit(weight) if isinstance(weight, (int, float)) else weight).otherwise(0.0)
    turn = F.when(known, phi - model).otherwise(0.0)
    c, s, n = F.sum(w * F.cos(turn)), F.sum(w * F.sin(turn)), F.sum(w)
    return F.when(n > 0, F.sqrt(c * c + s * s) / n)
