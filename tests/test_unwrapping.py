"""Whole-raster unwrapping against the single-tile solver, on rasters with residues."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.operators import kernels, unwrapping
from radarframe.plans.series import _written


def frame(images):
    out = []
    for k, z in images.items():
        r, c = np.mgrid[0 : z.shape[0], 0 : z.shape[1]].reshape(2, -1)
        out.append(pd.DataFrame({"id": k, "row": r + 5, "col": c - 2, "phi": z.ravel()}))
    return pd.concat(out)


def noisy(seed, shape, spread):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return kernels.wrapped(0.5 * y - 0.3 * x + 3 * np.sin(y / 7) + rng.normal(0, spread, shape))


def vortices(shape, pairs):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return kernels.wrapped(sum(s * np.arctan2(y - r - 0.5, x - c - 0.5) for r, c, s in pairs))


IMAGES = {
    "noise": noisy(1, (30, 37), 1.0), "strong": noisy(2, (24, 20), 3.0), "weak": noisy(3, (40, 31), 0.5), "plain": noisy(4, (12, 15), 0.0),
    "far": vortices((60, 60), [(20, 15, 1), (22, 44, -1), (40, 30, 1)]), "line": vortices((40, 90), [(18, 10 + 9 * k, (-1) ** (k // 2)) for k in range(8)]),
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(frame(IMAGES)).repartition(5)
    return unwrapping.unwrapped(df, ["id"], _written, radius=3).toPandas()


def cost_of(z, u):
    """Turns by which the surface's gradients differ from the wrapped ones."""
    return sum(int(np.abs(np.rint((np.diff(u, axis=a) - kernels.wrapped(np.diff(z, axis=a))) / (2 * np.pi))).sum()) for a in (0, 1))


@pytest.mark.parametrize("name", IMAGES)
def test_the_whole_costs_what_a_single_tile_does(got, name):
    z = IMAGES[name]
    u = got[got["id"] == name].sort_values(["row", "col"])["unwrapped"].to_numpy().reshape(z.shape)
    off = (u - z) / (2 * np.pi)
    assert np.abs(off - np.rint(off)).max() < 1e-9
    want, cost = kernels.unwrapped(z)
    assert cost_of(z, u) == cost_of(z, want) == cost
    assert cost > 0 or name == "plain"


def test_gates_add_up_to_the_cost(spark):
    df = spark.createDataFrame(frame({k: IMAGES[k] for k in ("noise", "far")}))
    g = {r["id"]: r["n"] for r in unwrapping.crossings(df, ["id"], _written, radius=2).groupBy("id").agg(F.sum(F.abs("turns")).alias("n")).collect()}
    assert g == {k: kernels.unwrapped(IMAGES[k])[1] for k in ("noise", "far")}


def test_pixels_without_a_phase_get_none(spark):
    z = noisy(6, (10, 12), 0.6)
    z[3, 4], z[7, 2] = np.nan, np.nan
    u = unwrapping.unwrapped(spark.createDataFrame(frame({"a": z})), ["id"], _written).toPandas().sort_values(["row", "col"])["unwrapped"].to_numpy(float).reshape(z.shape)
    assert (np.isnan(u) == np.isnan(z)).all()
    off = ((u - z) / (2 * np.pi))[~np.isnan(z)]
    assert np.abs(off - np.rint(off)).max() < 1e-9


def test_matching_is_cheapest_of_all():
    """Every way to pair few residues, the border among them."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        n_p, n_n = rng.integers(0, 5, 2)
        d, bp, bn = rng.integers(1, 9, (n_p, n_n)), rng.integers(1, 7, n_p), rng.integers(1, 7, n_n)
        keep = rng.random((n_p, n_n)) < 0.7
        edges = np.nonzero(keep)
        mate, u, v = unwrapping.matched(bp, bn, (edges[0], edges[1], d[edges]))
        cost = lambda m: sum(d[i, j] if j >= 0 else bp[i] for i, j in enumerate(m)) + sum(bn[j] for j in range(n_n) if j not in m)  # noqa: B023, E731
        ways = (m for m in itertools.product(*([-1, *np.nonzero(keep[i])[0]] for i in range(n_p))) if len({j for j in m if j >= 0}) == sum(j >= 0 for j in m))
        assert cost(mate.tolist()) == min(map(cost, ways)) == u.sum() + v.sum()
        assert (u[edges[0]] + v[edges[1]] <= d[edges]).all() and (u <= bp).all() and (v <= bn).all()
