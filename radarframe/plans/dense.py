"""Queries through geometry solvers, dense kernels and the scatterer pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from radarframe.operators import geometry, kernels, network, psi
from radarframe.operators import images as pair_images
from radarframe.plans.catalogue import query, table
from radarframe.plans.pixels import RASTER, pairs, pixels
from radarframe.plans.series import _written, daily, images

c = F.col
_A, _RATE, _TILT = 7.07e6, 2 * np.pi / 5924.0, np.radians(98.0)


def circular_orbit() -> geometry.Orbit:
    """State vectors every ten seconds on an inclined circle, fitted."""
    t = np.arange(-80.0, 81.0, 10.0)
    p = _A * np.stack([np.cos(_RATE * t), np.sin(_RATE * t) * np.cos(_TILT), np.sin(_RATE * t) * np.sin(_TILT)], 1)
    v = _A * _RATE * np.stack([-np.sin(_RATE * t), np.cos(_RATE * t) * np.cos(_TILT), np.cos(_RATE * t) * np.sin(_TILT)], 1)
    return geometry.Orbit.fit(t, p, v)


@query(
    f"""WITH t AS (SELECT c_custkey AS id, (c_custkey * 37 % 1500) / 10.0 - 75 AS t FROM customer)
    SELECT id, round({_A} * cos({_RATE} * t), 2) AS x, round({_A} * sin({_RATE} * t) * {np.cos(_TILT)}, 2) AS y, round({_A} * sin({_RATE} * t) * {np.sin(_TILT)}, 2) AS z FROM t"""
)
def orbit_fit(spark, sf_dir):
    """A fitted orbit between its state vectors."""
    k = c("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1500 / 10.0 - 75).alias("t"))
    return geometry.positions(t, circular_orbit()).select("id", *(F.round(v, 2).alias(v) for v in "xyz"))


@query("SELECT c_custkey AS id, round((c_custkey * 37 % 1200) / 10.0 - 60, 4) AS azt, round(800000.0 + (c_custkey * 53 % 1500) * 100, 2) AS rng, true AS converged FROM customer")
def localize_project(spark, sf_dir):
    """Image points to the ground and back."""
    k = c("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1200 / 10.0 - 60).alias("azt"), (800000.0 + k * 53 % 1500 * 100).alias("rng"), (c("c_acctbal") / 10).alias("alt"))
    back = geometry.project(geometry.localize(p, circular_orbit()), circular_orbit())
    return back.select("id", F.round("azt", 4).alias("azt"), F.round("rng", 2).alias("rng"), "converged")


@query()
def localize_on_dem(spark, sf_dir):
    """Image points on a surface of hills, found by altitude scan."""
    k = c("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1200 / 10.0 - 60).alias("azt"), (800000.0 + k * 53 % 1500 * 100).alias("rng"))
    hills = lambda lon, lat: 500 + 300 * np.sin(np.radians(40 * lon)) * np.cos(np.radians(40 * lat))
    return geometry.localize_on_surface(p, circular_orbit(), hills, -1000.0, 9000.0).select("id", *(F.round(v, 2).alias(v) for v in ("x", "y", "z", "alt")), "found")


def small_images(spark, sf_dir):
    """Each vector as an image of 8 x 8 pixels."""
    return table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("pixels"))


@query()
def fourier_zoom(spark, sf_dir):
    zoom = lambda x: [kernels.zoomed(x, 2).ravel()]
    wide = kernels.on_images(small_images(spark, sf_dir), (8, 8), zoom, "v array<double>")
    return wide.select("id", F.posexplode("v").alias("k", "v")).select("id", F.expr("k div 16").alias("row"), (c("k") % 16).alias("col"), F.round("v", 6).alias("v"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 8 > 4 THEN vec_id % 8 - 8 ELSE vec_id % 8 END AS rows, CASE WHEN vec_id * 3 % 8 > 4 THEN vec_id * 3 % 8 - 8 ELSE vec_id * 3 % 8 END AS cols FROM embeddings")
def phase_correlation(spark, sf_dir):
    """The shift between an image and itself turned by known numbers of rows and columns."""
    both = small_images(spark, sf_dir).select("id", F.concat("pixels", F.array((c("id") % 8).cast("float"), (c("id") * 3 % 8).cast("float"))).alias("pixels"))

    def shift(x):
        x = x.ravel()
        a = x[:64].reshape(8, 8)
        return list(kernels.correlation_shift(a, np.roll(a, (int(x[64]), int(x[65])), (0, 1)))[:2])

    done = kernels.on_images(both, (1, 66), shift, "rows double, cols double")
    return done.select("id", F.rint("rows").cast("long").alias("rows"), F.rint("cols").cast("long").alias("cols"))


@query()
def mcf_unwrap(spark, sf_dir):
    """Least-cost unwrapping of each small image."""

    def unwrap(x):
        u, cost = kernels.unwrapped(kernels.wrapped(x * 7))
        return [u.ravel(), cost]

    done = kernels.on_images(small_images(spark, sf_dir), (8, 8), unwrap, "u array<double>, cost int")
    return done.select("id", "cost", F.posexplode("u").alias("k", "u")).select("id", "cost", "k", F.round("u", 6).alias("u"))


@query()
def goldstein(spark, sf_dir):
    done = kernels.goldstein_filter(pair_images.crossed(pairs(spark, sf_dir)).select("row", "col", "re", "im"), 4, 3, 0.5, tile=64)
    return done.select("row", "col", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


_DY, _DX = 0.25, 0.6


def _sinc_weights(d: float) -> list[float]:
    k = np.arange(-3, 5)
    w = np.sinc(d - k) * np.sinc((d - k) / 4)
    return (w / w.sum()).tolist()


@query(
    f"""WITH {RASTER}, wy(i, w) AS (VALUES {', '.join(f'({k - 3}, {w!r})' for k, w in enumerate(_sinc_weights(_DY)))}), wx(j, w) AS (VALUES {', '.join(f'({k - 3}, {w!r})' for k, w in enumerate(_sinc_weights(_DX)))}),
    h AS (SELECT row, col - j AS col, sum(v * w) AS v, count(*) AS n FROM raster, wx GROUP BY 1, 2 HAVING count(*) = 8), k AS (SELECT row - i AS row, col, sum(v * w) AS v FROM h, wy GROUP BY 1, 2 HAVING count(*) = 8)
    SELECT r.row, r.col, round(k.v, 5) AS v FROM raster r LEFT JOIN k USING (row, col)"""
)
def lanczos_shift(spark, sf_dir):
    moved = kernels.warped(pixels(spark, sf_dir), "v", [[1, 0, _DY], [0, 1, _DX]], tile=64)
    return moved.select("row", "col", F.round("v", 5).alias("v"))


_NINE = ", ".join(f"max(CASE WHEN b.row - a.row = {i} AND b.col - a.col = {j} THEN b.v END) AS z{(i + 1) * 3 + j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))


@query(
    f"""WITH {RASTER}, a AS (SELECT * FROM raster), n AS (SELECT a.row, a.col, {_NINE} FROM a JOIN raster b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2 HAVING count(*) = 9),
    m AS (SELECT * FROM n WHERE z4 > greatest(z0, z1, z2, z3) AND z4 >= greatest(z5, z6, z7, z8)),
    q AS (SELECT row, col, (z2 + z5 + z8 - z0 - z3 - z6) / 6 AS gx, (z6 + z7 + z8 - z0 - z1 - z2) / 6 AS gy, (z2 + z5 + z8 + z0 + z3 + z6 - 2 * (z1 + z4 + z7)) / 6 AS a, (z6 + z7 + z8 + z0 + z1 + z2 - 2 * (z3 + z4 + z5)) / 6 AS b, (z8 + z0 - z2 - z6) / 4 AS k FROM m)
    SELECT row, col, round(row + (k * gx - 2 * a * gy) / (4 * a * b - k * k), 5) AS y, round(col + (k * gy - 2 * b * gx) / (4 * a * b - k * k), 5) AS x FROM q WHERE a < 0 AND 4 * a * b - k * k > 1e-6"""
)
def quadric_peak(spark, sf_dir):
    """Maxima of the interior to fractions of a pixel: the quadric of least squares over nine pixels; saddles give none."""
    from radarframe.operators import raster

    return raster.quadric_peaks(pixels(spark, sf_dir), "v").select("row", "col", F.round("y", 5).alias("y"), F.round("x", 5).alias("x"))


@query()
def periodogram_refined(spark, sf_dir):
    o = daily(spark, sf_dir).select("ps", "phi", c("day").cast("double").alias("day"), (c("day") * 7 % 5).cast("double").alias("b"))
    axis = [round(-0.45 + 0.05 * k, 2) for k in range(19)]
    best = psi.periodogram(o, {"v": "day", "q": "b"}, psi.grid(spark, {"v": axis, "q": axis}))
    done = psi.refined(o, best, {"v": "day", "q": "b"}, {"v": 0.05, "q": 0.05})
    return done.select("ps", *(F.round(k, 4).alias(k) for k in ("v", "q", "gamma")))


@query()
def psi_full(spark, sf_dir):
    d = daily(spark, sf_dir).select("ps", c("day").alias("t"), "phi", "amp", c("day").cast("double").alias("day"), (c("day") * 7 % 5).cast("double").alias("b"))
    places = d.select("ps").distinct().select("ps", (c("ps") % 17).cast("double").alias("x"), (c("ps") % 13).cast("double").alias("y"))
    rate, plane = [round(-0.45 + 0.05 * k, 2) for k in range(19)], [round(-0.1 + 0.02 * k, 2) for k in range(11)]
    done = psi.full(
        d, places, {"v": "day", "q": "b"}, psi.grid(spark, {"v": rate, "q": rate}), psi.grid(spark, {"sx": plane, "sy": plane}), {"v": 0.1, "q": 0.7}, {"v": 0.05, "q": 0.05}, _written,
        dispersion_below=0.75, gamma_above=0.5,
    )
    return done.select("ps", *(F.round(k, 4).alias(k) for k in ("v", "q", "gamma")))


@query()
def pair_network(spark, sf_dir):
    """A cheap connected network of the acquisition days."""
    p = network.all_pairs(images(spark, sf_dir)).withColumn("stack", F.lit(0))
    done = network.selected(p.withColumn("db", F.round("db", 6)), max_dt=6, max_degree=4)
    return done.select("id1", "id2", F.round("cost", 5).alias("cost"), "bridge")
