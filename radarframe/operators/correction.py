"""Chains of corrections: column functions, each estimating shifts of a point from the uncorrected columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions.phase import LIGHT_SPEED

#: Gives the shifts to add, by column: x, y, z of the ground or azt, rng of the image.
Correction = Callable[[], Mapping[str, Column]]


def corrected(df: DataFrame, chain: Sequence[Correction], inverse: bool = False) -> DataFrame:
    """All shifts are estimated on the initial columns and added in the chain's order; ``inverse`` takes them off. One projection, whatever the chain's length."""
    shifts = [c() for c in chain]
    names = list(dict.fromkeys(n for s in shifts for n in s))
    sign = -1 if inverse else 1
    return df.withColumns({n: reduce(lambda acc, s: acc + sign * s[n] if n in s else acc, shifts, F.col(n)) for n in names})


def constant(azt: float = 0.0, rng: float = 0.0) -> Correction:
    """The same shift of time and range for every point."""
    return lambda: {"azt": F.lit(azt), "rng": F.lit(rng)}


def pixels(col: float, row: float, azimuth_frequency: float, range_frequency: float) -> Correction:
    """A shift given in pixels of a slant-range image."""
    return constant(row / azimuth_frequency, col / range_frequency * LIGHT_SPEED / 2)
