"""Terrain operators on a patch of ground under a circular orbit."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import circle

from radarframe.operators import geometry, radar

FIRST_AZT, FREQUENCY, FIRST_RNG, STEP = -0.25, 40.0, 850_000.0, 60.0


@pytest.fixture(scope="module")
def orbit():
    t = np.arange(-80.0, 81.0, 10.0)
    return geometry.Orbit.fit(t, *circle(t))


@pytest.fixture(scope="module")
def dem(spark, orbit):
    """Nodes on the ellipsoid at a regular spacing in time and range, with a hill."""
    azt, rng = np.meshgrid(FIRST_AZT + np.arange(14) / FREQUENCY * 1.1, FIRST_RNG + np.arange(16) * STEP * 1.2, indexing="ij")
    hill = 40.0 * np.exp(-((np.arange(14)[:, None] - 7) ** 2 + (np.arange(16)[None, :] - 8) ** 2) / 8)
    m, done = geometry.on_ellipsoid(orbit, azt.ravel(), rng.ravel(), hill.ravel())
    assert done.all()
    rows = [(k // 16, k % 16, *map(float, m[k]), float(hill.ravel()[k])) for k in range(len(m))]
    return spark.createDataFrame(rows, "row long, col long, x double, y double, z double, h double")


def test_nodes_come_back_to_their_lines(dem, orbit):
    for r in radar.image_nodes(dem, orbit, FIRST_AZT, FREQUENCY, FIRST_RNG, STEP).collect():
        assert abs(r.line - r.row * 1.1) < 1e-3 and abs(r.sample - r.col * 1.2) < 1e-3


def test_linear_fields_are_radarcoded_exactly(dem, orbit):
    nodes = radar.image_nodes(dem, orbit, FIRST_AZT, FREQUENCY, FIRST_RNG, STEP).withColumn("f", 3 + 2 * F.col("line") - F.col("sample"))
    got = radar.radarcoded(nodes, "f", 17, 14).collect()
    assert len(got) >= 13 * 17
    assert all(abs(r.f - (3 + 2 * r.line - r.sample)) < 1e-3 for r in got)


def test_simulation_keeps_the_facing_area(dem, orbit):
    whole = radar.simulated(dem, orbit, FIRST_AZT, FREQUENCY, FIRST_RNG, STEP, 1.0, shadows=False)
    total = whole.agg(F.sum("area")).first()[0]
    nodes = {(r.row, r.col): r for r in radar.image_nodes(dem, orbit, FIRST_AZT, FREQUENCY, FIRST_RNG, STEP).collect()}
    expected = 0.0
    for (r, c) in nodes:
        if (r + 1, c + 1) in nodes:
            q = [nodes[k] for k in ((r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1))]
            for a, b, d in ((0, 1, 2), (3, 2, 1)):
                p = [np.array([q[k].x, q[k].y, q[k].z]) for k in (a, b, d)]
                look = np.array([q[a].lx, q[a].ly, q[a].lz])
                expected += abs(np.dot(np.cross(p[1] - p[0], p[2] - p[0]), look)) / 2
    assert total == pytest.approx(expected, rel=1e-6)
    lit = radar.simulated(dem, orbit, FIRST_AZT, FREQUENCY, FIRST_RNG, STEP, 1.0).agg(F.sum("area")).first()[0]
    assert 0 < lit <= total * (1 + 1e-9)
