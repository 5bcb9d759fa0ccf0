"""Viewing geometry over an image from polynomials: solved on a small grid of pixels, evaluated as columns on tables of any size; and coarse footprints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import geometry


@dataclass(frozen=True)
class Timing:
    """Time and range of an image's first pixel, lines a second, metres a sample, size."""

    first_azt: float
    azimuth_frequency: float
    first_rng: float
    range_step: float
    w: int
    h: int

    def at(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first_azt + rows / self.azimuth_frequency, self.first_rng + cols * self.range_step


def configuration(primary: geometry.Orbit, timing: Timing, secondaries: Sequence[geometry.Orbit], rows: np.ndarray, cols: np.ndarray) -> dict[str, np.ndarray]:
    """Incidence in radians on the ellipsoid, and per secondary the perpendicular baseline and the difference of the ranges."""
    azt, rng = timing.at(np.asarray(rows, float), np.asarray(cols, float))
    ground, _ = geometry.on_ellipsoid(primary, azt, rng, np.zeros(len(azt)))
    sensor, speed = primary.at(azt), primary.at(azt, 1)
    look = ground - sensor
    reach = np.linalg.norm(look, axis=1)
    look /= reach[:, None]
    up = np.cross(look, speed)
    up /= np.linalg.norm(up, axis=1, keepdims=True)
    away = np.sign((sensor * up).sum(1))
    cosine = -(look * ground).sum(1) / np.linalg.norm(ground, axis=1)
    found = {"incidence": np.arccos(np.clip(cosine, -1, 1))}
    for k, other in enumerate(secondaries):
        t, other_reach, _, _ = geometry.closest_approach(other, ground)
        found[f"b_perp_{k}"] = ((other.at(t) - sensor) * up).sum(1) * away
        found[f"delta_r_{k}"] = reach - other_reach
    return found


@dataclass(frozen=True)
class Predictor:
    """Coefficients by quantity over image coordinates scaled to [-1, 1]."""

    timing: Timing
    coefficients: dict[str, list[list[float]]]

    @staticmethod
    def fit(primary: geometry.Orbit, timing: Timing, secondaries: Sequence[geometry.Orbit], size: int = 20, degree: int = 7) -> Predictor:
        """Least squares of total degree ``degree`` on size x size pixels: a number that doesn't grow with the image."""
        cols, rows = (v.ravel() for v in np.meshgrid(np.linspace(0, timing.w - 1, size), np.linspace(0, timing.h - 1, size)))
        x, y = 2 * cols / (timing.w - 1) - 1, 2 * rows / (timing.h - 1) - 1
        powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
        basis = np.stack([x**i * y**j for i, j in powers], 1)
        fits = {}
        for name, z in configuration(primary, timing, secondaries, rows, cols).items():
            table = [[0.0] * (degree + 1 - i) for i in range(degree + 1)]
            for (i, j), v in zip(powers, np.linalg.lstsq(basis, z, rcond=None)[0], strict=True):
                table[i][j] = float(v)
            fits[name] = table
        return Predictor(timing, fits)

    def column(self, quantity: str, row: Column, col: Column) -> Column:
        return phase.surface(self.coefficients[quantity], 2 * col / (self.timing.w - 1) - 1, 2 * row / (self.timing.h - 1) - 1)

    def phases(self, k: int, row: Column, col: Column, height: Column, wavelength: float) -> tuple[Column, Column]:
        """Flat-earth and topographic phase of secondary ``k``."""
        slant = self.timing.first_rng + col * self.timing.range_step
        flat = phase.flat_earth(self.column(f"delta_r_{k}", row, col), wavelength)
        return flat, phase.topographic(height, self.column(f"b_perp_{k}", row, col), slant, self.column("incidence", row, col), wavelength)


def coarse_footprints(products: DataFrame, margin: int = 1000, alt_min: float = -1000.0, alt_max: float = 9000.0, right: bool = True) -> DataFrame:
    """Corners (lon, lat) of each product's rectangle, widened by ``margin`` pixels and seen at the lowest height in near range and the highest in far range.

    ``products``: id, states array of (t, x, y, z, vx, vy, vz), first_azt, azimuth_frequency, first_rng, range_step, w, h. One row a product
    travels through the worker, so products may be many; a batch's corners are solved together, and equal states are fitted once in it.
    States or sizes that are null, or hold one, give a null footprint.
    """
    schema = f"id {products.schema['id'].dataType.simpleString()}, footprint array<struct<lon: double, lat: double>>"
    names = "first_azt azimuth_frequency first_rng range_step w h".split()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            fixed = np.stack([np.asarray(column[n].to_numpy(zero_copy_only=False), float) for n in names], 1)
            flat = column["states"].flatten()
            states = np.stack([np.asarray(flat.field(k).to_numpy(zero_copy_only=False), float) for k in ("t", "x", "y", "z", "vx", "vy", "vz")], 1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column["states"]), 0).to_numpy(zero_copy_only=False))
            own = [states[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            good = [k for k in range(len(own)) if len(own[k]) > 1 and np.isfinite(own[k]).all() and np.isfinite(fixed[k]).all()]
            out = [None] * len(own)
            if good:
                fits, which = {}, []
                for k in good:
                    key = own[k].tobytes()
                    if key not in fits:
                        fits[key] = len(fits), geometry.Orbit.fit(own[k][:, 0], own[k][:, 1:4], own[k][:, 4:])
                    which.append(fits[key][0])
                orbits = geometry.Orbits.of([o for _, o in fits.values()], np.repeat(which, 4))
                azt0, frequency, rng0, step, w, h = fixed[good].T[:, :, None]
                zero = np.zeros_like(w)
                azt = azt0 + np.concatenate([zero - margin, zero - margin, h + margin, h + margin], 1) / frequency
                rng = rng0 + np.concatenate([zero - margin, w + margin, w + margin, zero - margin], 1) * step
                ground, _ = geometry.on_ellipsoid(orbits, azt.ravel(), rng.ravel(), np.tile([alt_min, alt_max, alt_max, alt_min], len(good)), right)
                for k, four in zip(good, geometry.to_geodetic(ground).reshape(-1, 4, 3).tolist(), strict=True):
                    out[k] = [{"lon": p[0], "lat": p[1]} for p in four]
            kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
            yield pa.RecordBatch.from_arrays([column["id"], pa.array(out, kind)], names=["id", "footprint"])

    return products.select("id", "states", *(F.col(n).cast("double").alias(n) for n in names)).mapInArrow(run, schema)


def bounds(footprints: DataFrame) -> DataFrame:
    """Least and largest longitude and latitude of each footprint: what a height model has to cover."""
    pick = lambda f, k: f(F.transform("footprint", lambda p: p[k]))
    return footprints.select("id", *(pick(f, k).alias(f"{k}_{n}") for k in ("lon", "lat") for n, f in (("min", F.array_min), ("max", F.array_max))))
