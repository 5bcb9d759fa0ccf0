"""Queries through sensor models: tables that mix products, lines of sight, and projections burst by burst."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from radarframe.functions.phase import LIGHT_SPEED
from radarframe.operators import models, resampling
from radarframe.plans.catalogue import query, table
from radarframe.plans.dense import _A, _RATE, _TILT, circular_orbit

c = F.col
_R = F.round
_LATE = {"s1": 0.5, "s2": 0.8}


def _states(late: float = 0.0) -> list[dict]:
    """State vectors of the circular orbit, flown some seconds later."""
    orbit, t = circular_orbit(), np.arange(-80.0, 81.0, 10.0)
    return [dict(zip(("t", "x", "y", "z", "vx", "vy", "vz"), map(float, (a + late, *p, *v)), strict=True)) for a, p, v in zip(t, orbit.at(t), orbit.at(t, 1), strict=True)]


def _products(spark, sf_dir):
    """A model a nation: slant and ground range, left and right looking by turns, each with times and steps of its own."""
    k = c("n_nationkey")
    states = spark.createDataFrame([(_states(),)], "states array<struct<t: double, x: double, y: double, z: double, vx: double, vy: double, vz: double>>")  # one row
    ground = F.array(*(F.struct(F.lit(t).alias("time"), F.lit(0.0).alias("gr0"), F.lit(0.0).alias("sr0"), F.array(F.lit(8e5), F.lit(0.6)).alias("grsr"), F.array(F.lit(-8e5 / 0.6), F.lit(1 / 0.6)).alias("srgr")) for t in (-80.0, 80.0)))
    slant = k % 3 < 2
    model = F.struct(
        F.when(slant, "slant").otherwise("ground").alias("sensor"), "states", (k * 1.5 - 60).cast("double").alias("first_azt"), (0.002 + k * 1e-5).cast("double").alias("line_time"), F.when(slant, 8e5 + k * 100.0).alias("first_rng"),
        F.when(slant, 2.0 + k * 0.1).otherwise(10.0 + k).cast("double").alias("range_step"), F.lit(5000).alias("width"), F.lit(9000).alias("height"), (k % 2 == 0).alias("right"), F.lit(0.055).alias("wavelength"),
        F.when(~slant, ground).alias("ground_range"),
    )
    return table(spark, sf_dir, "nation").join(F.broadcast(states)).select(k.alias("product"), model.alias("model"))


def _places(spark, sf_dir):
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").select(c("c_nationkey").alias("product"), k.alias("id"), (k * 37 % 9000 + 0.25).cast("double").alias("row"), (k * 53 % 5000 + 0.5).cast("double").alias("col"), (c("c_acctbal") / 10).cast("double").alias("alt"))


@query("SELECT c_custkey AS id, c_nationkey AS product, round(c_custkey * 37 % 9000 + 0.25, 3) AS row, round(c_custkey * 53 % 5000 + 0.5, 3) AS col, true AS converged FROM customer")
def mixed_sensors(spark, sf_dir):
    """Image places of products of several sensors, localised and projected again in one table."""
    bound = _products(spark, sf_dir)
    ground = models.localize(_places(spark, sf_dir), bound, ["id"])
    return models.project(ground.select("product", "id", "x", "y", "z"), bound, ["id"]).select("id", "product", _R("row", 3).alias("row"), _R("col", 3).alias("col"), "converged")


@query("SELECT c_custkey AS id, c_nationkey AS product, round((c_custkey * 17 % 1601 - 800) * 1.25, 3) AS doppler, round(1.0, 6) AS length FROM customer")
def squinted_sight(spark, sf_dir):
    """Lines of sight on the cone of a Doppler frequency: with the orbit's velocity at the time of sensing they give that frequency back."""
    bound = _products(spark, sf_dir)
    ground = models.localize(_places(spark, sf_dir), bound, ["id"])
    seen = models.line_of_sight(ground.withColumn("doppler", (c("id") * 17 % 1601 - 800) * 1.25), bound, ["id"])
    u = _RATE * c("azt")
    v = [-F.sin(u), F.cos(u) * float(np.cos(_TILT)), F.cos(u) * float(np.sin(_TILT))]
    f = 2 / 0.055 * _A * _RATE * (c("lx") * v[0] + c("ly") * v[1] + c("lz") * v[2])
    return seen.select("id", "product", _R(f, 3).alias("doppler"), _R(F.sqrt(c("lx") ** 2 + c("ly") ** 2 + c("lz") ** 2), 6).alias("length"))


_RAMP = dict(t0=0.0, dt=0.002, tau0=0.0053, dtau=2e-8, mid_tau=0.0058, ks=1700.0, fm=[-2300.0, 4e5], fm_tau=0.0053, dc=[[-40.0, 3e5]], dc_tau=0.0053)
_TAU = f"(2 * rng / {LIGHT_SPEED})"
_FM, _F = f"(-2300.0 + 4e5 * ({_TAU} - 0.0053))", f"(-40.0 + 3e5 * ({_TAU} - 0.0053))"
_MID = (-40.0 + 3e5 * (0.0058 - 0.0053)) / (-2300.0 + 4e5 * (0.0058 - 0.0053))


@query(
    f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1200) / 10.0 - 60 AS a, 800000.0 + c_custkey * 53 % 1500 * 100 AS rng FROM customer), b AS (SELECT 'b' || n_nationkey AS bsid, n_nationkey AS k, 5000 + 2500 * n_nationkey - 17 AS y0 FROM nation),
    s AS (SELECT p.*, b.*, product, a + late AS azt0, (y0 + 1475) * 0.002 - 70 + late AS mid FROM p JOIN b ON (a + 70) * 500 >= y0 AND (a + 70) * 500 < y0 + 2950, (VALUES ('s1', 0.5), ('s2', 0.8)) o(product, late)),
    d AS (SELECT *, {_F} + {_FM} * 1700.0 / ({_FM} - 1700.0) * (azt0 - mid - ({_MID!r} - {_F} / {_FM})) AS f FROM s),
    e AS (SELECT *, azt0 - 0.5 * ({_TAU} - (0.005 + k * 1e-5) - 0.5 * 20000 / 6.4e7) + f * (1 / (-2310.0 - k) - 1 / {_FM}) AS azt, rng - f / 1.08e12 * {LIGHT_SPEED} / 2 AS rng1 FROM d)
    SELECT id, product, bsid, round(azt0, 5) AS azt0, round(azt, 6) AS azt, round(rng1, 3) AS rng, round((azt - mid + 2.95) / 0.002, 2) AS row, round((rng1 - 8e5 - k) / 3, 3) AS col FROM e"""
)
def secondary_projection(spark, sf_dir):
    """Ground points in the bursts of two secondary products, corrected by each burst's own chain; two bursts where the primary's overlap."""
    from radarframe.operators import geometry

    k = c("c_custkey")
    orbit = circular_orbit()
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1200 / 10.0 - 60).alias("azt"), (800000.0 + k * 53 % 1500 * 100).alias("rng"), (c("c_acctbal") / 10).cast("double").alias("alt"))
    ground = geometry.localize(p, orbit).join(p.select("id", "alt"), "id")
    seen = geometry.project(ground, orbit).select("id", F.lit(1).alias("acquisition"), ((c("azt") + 70) * 500).alias("row"), ((c("rng") - 8e5) / 3).alias("col"))
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.concat(F.lit("b"), c("n_nationkey").cast("string")).alias("bsid"), (5000 + 2500 * c("n_nationkey") - 17).cast("int").alias("y0"))
    # a point's place is known to some nanoseconds: places half a line off the borders can't fall on either side
    boxes = n.select(F.lit(1).alias("acquisition"), "bsid", F.lit(-100).alias("col"), c("y0").alias("row"), F.lit(60_000).alias("w"), F.lit(2950).alias("h"))
    hits = models.in_bursts(seen, boxes).join(ground, "id").select("id", "bsid", "x", "y", "z", "alt")
    both = hits.withColumn("product", F.explode(F.array(*(F.lit(s) for s in _LATE))))
    late = F.when(c("product") == "s1", _LATE["s1"]).otherwise(_LATE["s2"])
    frames = n.withColumn("product", F.explode(F.array(*(F.lit(s) for s in _LATE)))).withColumn("mid_azt", (c("y0") + 1475) * 0.002 - 70 + late)
    ramp = spark.createDataFrame([(_RAMP,)], f"ramp {resampling.RAMP}")  # one row
    frames = frames.join(F.broadcast(ramp)).select(
        "product", "bsid", (c("mid_azt") - 2.95).alias("first_azt"), F.lit(0.002).alias("line_time"), (8e5 + c("k")).cast("double").alias("first_rng"), F.lit(3.0).alias("range_step"), "mid_azt",
        F.struct((0.005 + c("k") * 1e-5).alias("slant_time"), F.lit(20000.0).alias("samples"), F.lit(6.4e7).alias("frequency")).alias("bistatic"), F.lit(1.08e12).alias("chirp_rate"), (-2310.0 - c("k")).alias("fm_geometry"), "ramp",
    )
    bound = spark.createDataFrame([(s, dict(sensor="s1-burst", states=_states(d), first_azt=0.0, line_time=0.002, first_rng=8e5, range_step=3.0, width=1, height=1, right=True, wavelength=0.055, ground_range=None)) for s, d in _LATE.items()], f"product string, model {models.MODEL}")
    done = models.secondary_projection(both, frames, bound, ["id"], ["bistatic", "chirp_rate", "fm_geometry"])
    return done.select("id", "product", "bsid", _R("azt0", 5).alias("azt0"), _R("azt", 6).alias("azt"), _R("rng", 3).alias("rng"), _R("row", 2).alias("row"), _R("col", 3).alias("col"))
