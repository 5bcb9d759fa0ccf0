"""Invariants of the dense kernels, the geometry solvers and their Spark forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarframe.operators import geometry, kernels

RNG = np.random.default_rng(7)


def circle(t):
    """A satellite on an inclined circular orbit: positions and velocities."""
    a, rate, tilt = 7.07e6, 2 * math.pi / 5924.0, math.radians(98)
    p = a * np.stack([np.cos(rate * t), np.sin(rate * t) * math.cos(tilt), np.sin(rate * t) * math.sin(tilt)], 1)
    v = a * rate * np.stack([-np.sin(rate * t), np.cos(rate * t) * math.cos(tilt), np.cos(rate * t) * math.sin(tilt)], 1)
    return p, v


@pytest.fixture(scope="module")
def orbit():
    t = np.arange(-80.0, 81.0, 10.0)
    return geometry.Orbit.fit(t, *circle(t))


def test_orbit_follows_the_circle(orbit):
    t = np.linspace(-80, 80, 333)
    p, v = circle(t)
    assert np.abs(orbit.at(t) - p).max() < 1e-5
    assert np.abs(orbit.at(t, 1) - v).max() < 1e-5
    assert abs(orbit.ascending_node()) < 1e-6


@pytest.mark.parametrize("right", [True, False])
def test_localize_then_project(spark, orbit, right):
    pts = [(k, float(a), float(r), float(h)) for k, (a, r, h) in enumerate((a, r, h) for a in np.linspace(-40, 40, 6) for r in np.linspace(8e5, 9.5e5, 5) for h in (0.0, 1500.0))]
    df = spark.createDataFrame(pts, "id long, azt double, rng double, alt double")
    ground = geometry.localize(df, orbit, right)
    back = {r.id: r for r in geometry.project(ground, orbit).collect()}
    for k, a, r, _ in pts:
        assert back[k].converged and abs(back[k].azt - a) < 1e-6 and abs(back[k].rng - r) < 1e-3
    m = np.array([[r.x, r.y, r.z] for r in ground.orderBy("id").collect()])
    assert np.abs(geometry.to_geodetic(m)[:, 2] - [p[3] for p in pts]).max() < 2.0


def test_localize_on_a_sloping_surface(spark, orbit):
    df = spark.createDataFrame([(k, float(a), float(r)) for k, (a, r) in enumerate((a, r) for a in (-20, 0, 20) for r in (8.2e5, 9e5))], "id long, azt double, rng double")
    slope = lambda lon, lat: 500 + 20 * lat + 5 * lon
    got = geometry.localize_on_surface(df, orbit, slope, -1000.0, 9000.0).collect()
    g = geometry.to_geodetic(np.array([[r.x, r.y, r.z] for r in got]))
    assert all(r.found for r in got)
    assert np.abs(np.array([r.alt for r in got]) - slope(g[:, 0], g[:, 1])).max() < 1e-3
    assert not any(r.found for r in geometry.localize_on_surface(df, orbit, lambda lon, lat: 0 * lon + 2e4, -1000.0, 9000.0).collect())


def test_orbits_are_fitted_by_key(spark):
    rows = [(k, float(t), *map(float, p), *map(float, v)) for k in range(3) for t, p, v in zip(np.arange(0, 160.0, 10) + k, *circle(np.arange(0, 160.0, 10) + k), strict=True)]
    fitted = geometry.fit_orbits(spark.createDataFrame(rows, "key int, t double, x double, y double, z double, vx double, vy double, vz double")).collect()
    for r in fitted:
        o = geometry.Orbit(r.t0, r.t1, np.array(r.coefficients).T)
        assert np.abs(o.at([r.t0 + 33.3]) - circle(np.array([r.t0 + 33.3]))[0]).max() < 1e-4


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (4, 6), (7, 2)])
@pytest.mark.parametrize("z", [1, 2, 3, 5])
def test_zoom_keeps_the_samples(shape, z):
    x = RNG.normal(size=shape)
    assert np.allclose(kernels.zoomed(x, z)[::z, ::z], x)
    assert np.allclose(kernels.zoomed(x + 1j * x.T.copy().reshape(shape), z)[::z, ::z], x + 1j * x.T.copy().reshape(shape))


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_goldstein_in_tiles_equals_the_whole(spark, alpha):
    z = RNG.normal(size=(40, 48)) + 1j * RNG.normal(size=(40, 48))
    z[3:6, 10:14] = np.nan
    whole = kernels.goldstein(z, 4, 3, alpha)
    rows = [(r, c, float(z[r, c].real), float(z[r, c].imag)) for r in range(40) for c in range(48)]
    df = spark.createDataFrame(rows, "row long, col long, re double, im double")
    got = np.full(z.shape, np.nan, complex)
    for r in kernels.goldstein_filter(df, 4, 3, alpha, tile=16).collect():
        if r.re is not None:
            got[r.row, r.col] = r.re + 1j * r.im
    assert np.allclose(got, whole, equal_nan=True)
    assert (np.isnan(got) == np.isnan(z)).all()
    if alpha == 0:
        assert np.allclose(got, z, equal_nan=True)


def test_goldstein_leaves_a_constant_field(spark):
    out = kernels.goldstein(np.ones((64, 64), complex), 4, 3, 0.5)
    assert np.allclose(out[16:-16, 16:-16], 1)


def test_shifts_are_found():
    a = RNG.normal(size=(16, 20))
    for r, c in ((0, 0), (3, -4), (-7, 9)):
        assert np.allclose(kernels.correlation_shift(a, np.roll(a, (r, c), (0, 1)))[:2], (r, c), atol=1e-6)


def test_lanczos_and_fits():
    y, x = np.mgrid[0:30, 0:30].astype(float)
    smooth = np.sin(x / 6) + np.cos(y / 7)
    r, c = y[8:20, 8:20] + 0.3, x[8:20, 8:20] + 0.6
    assert np.abs(kernels.lanczos(smooth, r, c) - (np.sin(c / 6) + np.cos(r / 7))).max() < 5e-3
    assert np.isnan(kernels.lanczos(smooth, np.array([0.5]), np.array([9.0]))).all()
    src = RNG.uniform(0, 100, (50, 2))
    a = np.array([[1.01, 0.02, 5.0], [-0.03, 0.98, -7.0]])
    assert np.allclose(kernels.total_least_squares(src, src @ a[:, :2].T + a[:, 2]), a)
    p, q = RNG.uniform(0, 1e4, (2, 1000))
    assert np.allclose(kernels.surface_fit(p, q, 3 + 2 * p - q, 1)(p, q), 3 + 2 * p - q)


def test_unwrapping():
    y, x = np.mgrid[0:50, 0:60].astype(float)
    ramp = x * 2 * math.pi / 3 + y * 2 * math.pi / 3
    got, cost = kernels.unwrapped(kernels.wrapped(ramp))
    assert cost == 0 and np.ptp(got - ramp) < 1e-9
    noisy = ramp + RNG.normal(0, math.pi / 12, ramp.shape)
    got, _ = kernels.unwrapped(kernels.wrapped(noisy))
    off = np.rint((got - noisy) / (2 * math.pi))
    assert np.abs(wrapped_residual := kernels.wrapped(got - noisy)).max() < 1e-6, wrapped_residual
    assert (off != np.median(off)).mean() < 0.01


@pytest.mark.parametrize("seed", range(6))
def test_unwrapping_random_fields_is_congruent(seed):
    phi = np.random.default_rng(seed).uniform(-math.pi, math.pi, (9, 11))
    got, cost = kernels.unwrapped(phi)
    assert np.abs(kernels.wrapped(got - phi)).max() < 1e-9
    turns = sum(int(np.abs(np.rint((np.diff(got, axis=k) - kernels.wrapped(np.diff(phi, axis=k))) / (2 * math.pi))).sum()) for k in (0, 1))
    assert turns == cost


def test_tiles_keep_every_pixel_once(spark):
    df = spark.range(37 * 29).select((F.col("id") / 29).cast("long").alias("row"), (F.col("id") % 29).alias("col"), F.col("id").cast("double").alias("v"))
    got = kernels.tiled(df, ["v"], 8, 3, lambda a: {"v": a["v"]}, ["v"]).collect()
    assert len(got) == 37 * 29 and all(r.v == r.row * 29 + r.col for r in got)
