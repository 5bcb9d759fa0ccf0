"""The scatterer pipeline and pair networks against simulations and brute force."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from radarframe.operators import network, psi


def simulated(n_ps=24, n_t=24, noise=0.05):
    rng = np.random.default_rng(3)
    t = np.arange(n_t, dtype=float)
    b = np.array([(k * 7 % 5) - 2.0 for k in range(n_t)])
    rows, places, truth = [], [], {}
    slopes = rng.uniform(-0.08, 0.08, (n_t, 2))
    for ps in range(n_ps):
        x, y = float(ps % 6), float(ps // 6)
        v, q = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)
        truth[ps] = (v, q)
        places.append((ps, x, y))
        phi = v * t + q * b + slopes[:, 0] * x + slopes[:, 1] * y + rng.normal(0, noise, n_t)
        rows += [(ps, k, float(math.remainder(p, 2 * math.pi)), 1.0 + 0.1 * (k % 2), float(t[k]), float(b[k])) for k, p in enumerate(phi)]
    return rows, places, truth


def test_refinement_beats_the_grid(spark):
    rows = [(ps, math.remainder(0.317 * t - 0.223 * ((t * 7) % 5), 2 * math.pi), float(t), float((t * 7) % 5)) for ps in range(3) for t in range(20)]
    series = spark.createDataFrame(rows, "ps long, phi double, t double, b double")
    axis = [round(-0.5 + 0.1 * k, 1) for k in range(11)]
    best = psi.periodogram(series, {"v": "t", "q": "b"}, psi.grid(spark, {"v": axis, "q": axis}))
    for r in psi.refined(series, best, {"v": "t", "q": "b"}, {"v": 0.1, "q": 0.1}).collect():
        assert abs(r.v - 0.317) < 1e-4 and abs(r.q + 0.223) < 1e-4 and r.gamma > 0.999999


def test_pipeline_keeps_coherent_scatterers(spark):
    rows, places, truth = simulated()
    rng = random.Random(1)
    rows += [(100, k, rng.uniform(-3, 3), 1.0, float(k), float((k * 7 % 5) - 2)) for k in range(24)]  # incoherent
    rows += [(101, k, 0.0, float(1 + 10 * (k % 2)), float(k), 0.0) for k in range(24)]  # unstable amplitude
    series = spark.createDataFrame(rows, "ps long, t int, phi double, amp double, bt double, bp double")
    spots = spark.createDataFrame([*places, (100, 1.0, 1.0), (101, 2.0, 1.0)], "ps long, x double, y double")
    axis, plane = [round(-0.4 + 0.05 * k, 2) for k in range(17)], [round(-0.1 + 0.02 * k, 2) for k in range(11)]
    cut = lambda d: spark.createDataFrame(d.collect(), d.schema)
    got = psi.full(series, spots, {"v": "bt", "q": "bp"}, psi.grid(spark, {"v": axis, "q": axis}), psi.grid(spark, {"sx": plane, "sy": plane}), {"v": 0.06, "q": 0.06}, {"v": 0.05, "q": 0.05}, cut).collect()
    assert {r.ps for r in got} <= set(truth)
    assert len(got) >= 0.8 * len(truth)
    # rates are relative to a common one, which the planes' bias takes up
    dv = np.array([r.v - truth[r.ps][0] for r in got])
    assert np.median(np.abs(dv - np.median(dv))) < 0.03


def test_selection_equals_step_by_step_greed(spark):
    rng = random.Random(5)
    images = [(k, rng.uniform(0, 60), rng.uniform(-50, 50)) for k in range(14)]
    df = spark.createDataFrame(images, "id long, t double, b double")
    pairs = network.all_pairs(df).withColumn("stack", F.lit(1))
    got = network.selected(pairs, 1.0, 0.5, max_dt=20, max_db=40, max_degree=3, max_pairs=9).collect()

    every = {(a[0], b[0]): (abs(a[1] - b[1]), abs(a[2] - b[2])) for a, b in itertools.combinations(images, 2)}
    cost = {p: d + 0.5 * e for p, (d, e) in every.items()}
    kept = []

    def valid(chosen):
        degree = [sum(k in p for p in chosen) for k in range(14)]
        return len(chosen) <= 9 and max(degree) <= 3 and all(every[p][0] <= 20 and every[p][1] <= 40 for p in chosen)

    while options := [p for p in every if p not in kept and valid([*kept, p])]:
        kept.append(min(options, key=lambda p: cost[p]))
    assert {(r.id1, r.id2) for r in got if not r.bridge} == set(kept)
    v, e = df.select("id"), spark.createDataFrame([(r.id1, r.id2) for r in got], "a long, b long")
    assert {r.component for r in network.components(v, e, lambda d: spark.createDataFrame(d.collect(), d.schema)).collect()} == {0}


def test_missing_phases_weigh_nothing(spark):
    axes = psi.grid(spark, {"v": [0.0, 0.5, 1.0]})
    rows = [("a", 0.5 * t, float(t)) for t in range(8)]
    odd = spark.createDataFrame([*rows, ("a", float("nan"), 8.0), ("a", None, 9.0), ("b", None, 1.0)], "ps string, phi double, x double")
    got = {r.ps: (r.n, r.gamma, r.v) for r in psi.periodogram(odd, {"v": "x"}, axes).collect()}
    assert got["a"] == (8, 1.0, 0.5) and got["b"][:2] == (0, None)
    plane = psi.planar(odd.selectExpr("ps as t", "phi", "x", "0.0D as y"), psi.grid(spark, {"sx": [0.0, 0.5, 1.0], "sy": [0.0]}))
    assert {r.t: (r.n, r.gamma) for r in plane.collect()} == {"a": (8, 1.0), "b": (0, None)}
