"""Orbits and range-Doppler geometry: points meet an orbit's polynomials in vectorised Newton steps.

An orbit is some dozen state vectors of one product, so it travels with the task; points are a table of any
size, solved batch by batch where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from radarframe.functions.phase import WGS84_A, WGS84_E2

DEGREE, VELOCITY_WEIGHT = 11, 0.16
AZIMUTH_TOL, ROUNDS = 1.2e-7, 20


@dataclass(frozen=True)
class Orbit:
    """Chebyshev coefficients (degree + 1, 3) of the position over [start, end]."""

    start: float
    end: float
    coefficients: np.ndarray

    @staticmethod
    def fit(times, positions, velocities, degree: int = DEGREE) -> Orbit:
        """Least squares on positions and, with their weight, velocities; both ends are met exactly."""
        t, p, v = (np.asarray(x, float) for x in (times, positions, velocities))
        order = np.argsort(t)
        t, p, v = t[order], p[order], v[order]
        degree = min(degree, 2 * len(t) - 1)
        half = (t[-1] - t[0]) / 2
        u = (t - t[0]) / half - 1
        value = np.polynomial.chebyshev.chebvander(u, degree)
        slope = np.stack([np.polynomial.chebyshev.chebval(u, np.polynomial.chebyshev.chebder(row)) for row in np.eye(degree + 1)], 1)
        a = np.concatenate([value, VELOCITY_WEIGHT * slope])
        b = np.concatenate([p, VELOCITY_WEIGHT * half * v])
        ends = value[[0, -1]]
        system = np.block([[a.T @ a, ends.T], [ends, np.zeros((2, 2))]])
        solved = np.linalg.lstsq(system, np.concatenate([a.T @ b, p[[0, -1]]]), rcond=None)[0]
        return Orbit(float(t[0]), float(t[-1]), solved[: degree + 1])

    def at(self, t, order: int = 0) -> np.ndarray:
        """Position, velocity, acceleration or a higher derivative (n, 3)."""
        half = (self.end - self.start) / 2
        c = np.polynomial.chebyshev.chebder(self.coefficients, order) if order else self.coefficients
        return np.polynomial.chebyshev.chebval((np.asarray(t, float) - self.start) / half - 1, c).T / half**order

    def ascending_node(self) -> float | None:
        """The first time at which z rises through zero within the orbit's span."""
        t = np.linspace(self.start, self.end, 2001)
        z = self.at(t)[:, 2]
        up = np.nonzero((z[:-1] < 0) & (z[1:] >= 0))[0]
        if not len(up):
            return None
        now = t[up[0]]
        for _ in range(ROUNDS):
            step = float(self.at([now])[0, 2] / self.at([now], 1)[0, 2])
            now -= step
            if abs(step) < 1e-9:
                break
        return float(now)


@dataclass(frozen=True)
class Orbits:
    """Orbits of many products side by side: point i is met by the i-th of start, end and coefficients (n, degree + 1, 3)."""

    start: np.ndarray
    end: np.ndarray
    coefficients: np.ndarray

    @staticmethod
    def of(orbits: list[Orbit], which: np.ndarray) -> Orbits:
        """``which`` says each point's orbit; lower degrees are filled up with zeros."""
        c = np.zeros((len(orbits), max(len(o.coefficients) for o in orbits), 3))
        for k, o in enumerate(orbits):
            c[k, : len(o.coefficients)] = o.coefficients
        return Orbits(np.array([o.start for o in orbits])[which], np.array([o.end for o in orbits])[which], c[which])

    def at(self, t, order: int = 0) -> np.ndarray:
        half = (self.end - self.start) / 2
        c = np.polynomial.chebyshev.chebder(self.coefficients, order, axis=1) if order else self.coefficients
        basis = np.polynomial.chebyshev.chebvander((np.asarray(t, float) - self.start) / half - 1, c.shape[1] - 1)
        return np.einsum("nk,nkd->nd", basis, c) / half[:, None] ** order


def closest_approach(orbit: Orbit, points: np.ndarray, half_wave_doppler: np.ndarray | float = 0.0):
    """Azimuth time, range, incidence in degrees, convergence of ground points (n, 3)."""
    t = np.full(len(points), (orbit.start + orbit.end) / 2)
    done = np.zeros(len(points), bool)
    doppler = np.broadcast_to(half_wave_doppler, t.shape)
    for _ in range(ROUNDS):
        left = np.nonzero(~done)[0]  # points that stand still take no further part
        if not len(left):
            break
        at, h = t[left], doppler[left]
        d, v, a = points[left] - orbit.at(at), orbit.at(at, 1), orbit.at(at, 2)
        r = np.linalg.norm(d, axis=1)
        along = (v * d).sum(1)
        f = along - h * r
        slope = (a * d).sum(1) - (v * v).sum(1) + h * along / r
        step = f / slope
        t[left] = np.clip(at - step, orbit.start - (orbit.end - orbit.start) / 4, orbit.end + (orbit.end - orbit.start) / 4)
        done[left] = np.abs(step) < AZIMUTH_TOL
    d = points - orbit.at(t)
    r = np.linalg.norm(d, axis=1)
    cosine = -(d * points).sum(1) / (r * np.linalg.norm(points, axis=1))
    return t, r, np.degrees(np.arccos(np.clip(cosine, -1, 1))), done


def on_ellipsoid(orbit: Orbit, azt: np.ndarray, rng: np.ndarray, alt: np.ndarray, right: bool = True):
    """Ground points (n, 3) seen at zero Doppler from azimuth times and ranges, on the ellipsoid raised by ``alt``; and convergence."""
    s, v = orbit.at(azt), orbit.at(azt, 1)
    along = v / np.linalg.norm(v, axis=1, keepdims=True)
    height = np.linalg.norm(s, axis=1)
    up = s - (s * along).sum(1, keepdims=True) * along
    up /= np.linalg.norm(up, axis=1, keepdims=True)
    side = np.cross(along, up) * (1.0 if right else -1.0)
    cosine = np.clip((height**2 + rng**2 - (WGS84_A - 10_000 + alt) ** 2) / (2 * height * rng), -1, 1)
    m = s + rng[:, None] * (np.sqrt(1 - cosine**2)[:, None] * side - cosine[:, None] * up)
    big, small = (WGS84_A + alt) ** 2, (WGS84_A * np.sqrt(1 - WGS84_E2) + alt) ** 2
    axes = np.stack([1 / big, 1 / big, 1 / small], 1)
    done = np.zeros(len(m), bool)
    for _ in range(ROUNDS):
        d = m - s
        f = np.stack([(along * d).sum(1), ((d * d).sum(1) - rng**2) / rng, ((m * m * axes).sum(1) - 1) * WGS84_A / 2], 1)
        jacobian = np.stack([along, 2 * d / rng[:, None], m * axes * WGS84_A], 1)
        good = np.abs(np.linalg.det(jacobian)) > 1e-12
        step = np.zeros_like(m)
        step[good] = np.linalg.solve(jacobian[good], f[good][:, :, None])[:, :, 0]
        m = m - step
        done = good & (np.linalg.norm(step, axis=1) < 1e-4)
        if done.all():
            break
    return m, done


def to_geodetic(m: np.ndarray) -> np.ndarray:
    """Longitude, latitude (degrees) and altitude (n, 3)."""
    flat = np.hypot(m[:, 0], m[:, 1])
    lat = np.arctan2(m[:, 2], flat * (1 - WGS84_E2))
    for _ in range(6):
        n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(lat) ** 2)
        lat = np.arctan2(m[:, 2] + WGS84_E2 * n * np.sin(lat), flat)
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(lat) ** 2)
    return np.stack([np.degrees(np.arctan2(m[:, 1], m[:, 0])), np.degrees(lat), flat * np.cos(lat) + m[:, 2] * np.sin(lat) - WGS84_A**2 / n], 1)


def _batched(df: DataFrame, names: list[str], solve: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """``id`` and what ``solve`` makes of the named double columns, batch by batch."""
    kind = dict(df.dtypes)["id"]

    def run(batches):
        import pyarrow as pa

        out = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            if batch.num_rows:
                made = solve(*(np.asarray(batch.column(k + 1)) for k in range(len(names))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], names=["id", *out])

    return df.select("id", *(df[n].cast("double") for n in names)).mapInArrow(run, f"id {kind}, {schema}")


def positions(times: DataFrame, orbit: Orbit, order: int = 0) -> DataFrame:
    """id, x, y, z of the orbit, or of its derivative, at times (id, t)."""
    return _batched(times, ["t"], lambda t: [np.ascontiguousarray(v) for v in orbit.at(t, order).T], "x double, y double, z double")


def project(points: DataFrame, orbit: Orbit, half_wave_doppler: float = 0.0) -> DataFrame:
    """id, azt, rng, incidence, converged of ground points (id, x, y, z)."""
    return _batched(points, ["x", "y", "z"], lambda x, y, z: list(closest_approach(orbit, np.stack([x, y, z], 1), half_wave_doppler)), "azt double, rng double, incidence double, converged boolean")


def project_with_look(points: DataFrame, orbit: Orbit, half_wave_doppler: float = 0.0) -> DataFrame:
    """What :func:`project` gives, with the unit vector lx, ly, lz from the sensor to the point and the angle ``off`` from the sensor's nadir in radians."""

    def solve(x, y, z):
        ground = np.stack([x, y, z], 1)
        t, r, incidence, done = closest_approach(orbit, ground, half_wave_doppler)
        s = orbit.at(t)
        look = (ground - s) / r[:, None]
        off = np.arccos(np.clip(-(look * s).sum(1) / np.linalg.norm(s, axis=1), -1, 1))
        return [t, r, incidence, done, *(np.ascontiguousarray(look[:, k]) for k in range(3)), off]

    return _batched(points, ["x", "y", "z"], solve, "azt double, rng double, incidence double, converged boolean, lx double, ly double, lz double, off double")


def localize(points: DataFrame, orbit: Orbit, right: bool = True) -> DataFrame:
    """id, x, y, z, converged of image points (id, azt, rng, alt)."""

    def solve(azt, rng, alt):
        m, done = on_ellipsoid(orbit, azt, rng, alt, right)
        return [*(np.ascontiguousarray(m[:, k]) for k in range(3)), done]

    return _batched(points, ["azt", "rng", "alt"], solve, "x double, y double, z double, converged boolean")


def localize_on_surface(points: DataFrame, orbit: Orbit, height: Callable, low: float, high: float, right: bool = True, steps: int = 100) -> DataFrame:
    """id, x, y, z, alt, found of image points (id, azt, rng) on the surface ``height(lon, lat)``.

    Altitudes from ``low`` to ``high`` are scanned for the first change of sign of altitude minus height, and the
    crossing is narrowed by regula falsi. ``found`` is false where the scan meets no crossing.
    """

    def solve(azt, rng):
        def gap(alt):
            m, done = on_ellipsoid(orbit, azt, rng, alt, right)
            g = to_geodetic(m)
            return np.where(done, alt - height(g[:, 0], g[:, 1]), np.nan), m

        a = np.full(len(azt), low)
        fa, m = gap(a)
        b, fb, found = a.copy(), fa.copy(), fa == 0
        for alt in np.linspace(low, high, steps)[1:]:
            if found.all():
                break
            here = np.full(len(azt), alt)
            f, _ = gap(here)
            hit = ~found & (np.sign(f) != np.sign(fa)) & ~np.isnan(f) & ~np.isnan(fa)
            b, fb = np.where(hit, here, b), np.where(hit, f, fb)
            found = found | hit
            a, fa = np.where(found, a, here), np.where(found, fa, f)
        alt = a
        for _ in range(40):
            with np.errstate(invalid="ignore", divide="ignore"):
                alt = np.where(fb != fa, a - fa * (b - a) / (fb - fa), a)
            f, m = gap(alt)
            left = np.sign(f) == np.sign(fa)
            a, fa = np.where(left, alt, a), np.where(left, f, fa * np.where(left, 1, 0.5))
            b, fb = np.where(left, b, alt), np.where(left, fb * 0.5, f)
            if not found.any() or np.nanmax(np.abs(f[found])) < 1e-4:
                break
        return [*(np.where(found, m[:, k], np.nan) for k in range(3)), np.where(found, alt, np.nan), found]

    return _batched(points, ["azt", "rng"], solve, "x double, y double, z double, alt double, found boolean")


def fit_orbits(states: DataFrame, degree: int = DEGREE) -> DataFrame:
    """key, t0, t1, coefficients (a list for each axis) of state vectors (key, t, x, y, z, vx, vy, vz); a key is one product."""
    kind = dict(states.dtypes)["key"]

    def one(pdf):
        import pandas as pd

        o = Orbit.fit(pdf["t"], pdf[["x", "y", "z"]], pdf[["vx", "vy", "vz"]], degree)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "t0": [o.start], "t1": [o.end], "coefficients": [o.coefficients.T.tolist()]})

    return states.groupBy("key").applyInPandas(one, f"key {kind}, t0 double, t1 double, coefficients array<array<double>>")


def node_crossings(states: DataFrame) -> DataFrame:
    """key, t: when each orbit of state vectors (key, t, x, y, z, vx, vy, vz) first rises through the equator; null if it doesn't within them."""
    kind = dict(states.dtypes)["key"]

    def one(pdf):
        import pandas as pd

        o = Orbit.fit(pdf["t"], pdf[["x", "y", "z"]], pdf[["vx", "vy", "vz"]])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "t": [o.ascending_node()]}).astype({"t": "float64"})

    return states.groupBy("key").applyInPandas(one, f"key {kind}, t double")
