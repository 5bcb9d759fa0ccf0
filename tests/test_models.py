"""Sensor models, lines of sight and secondary projections against loops over single points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.functions.phase import LIGHT_SPEED
from radarframe.operators import geometry, models, resampling
from radarframe.plans.dense import circular_orbit

c = F.col
ORBIT = circular_orbit()


def states(late=0.0):
    t = np.arange(-80.0, 81.0, 10.0)
    return [dict(zip(("t", "x", "y", "z", "vx", "vy", "vz"), map(float, (a + late, *p, *v)), strict=True)) for a, p, v in zip(t, ORBIT.at(t), ORBIT.at(t, 1), strict=True)]


SLANT = dict(sensor="slant", states=states(), first_azt=-10.0, line_time=0.002, first_rng=8.5e5, range_step=3.0, width=5000, height=8000, right=True, wavelength=0.055, ground_range=None)
LATE = SLANT | dict(sensor="late", states=states(0.5), first_azt=-9.0, range_step=2.5)
GROUND = SLANT | dict(sensor="ground", range_step=10.0, first_rng=None, ground_range=[dict(time=t, gr0=0.0, sr0=8.5e5, grsr=[8.5e5, 0.6 + k / 1000], srgr=[0.0, 1 / (0.6 + k / 1000)]) for k, t in enumerate((-10.0, -2.0, 5.0))])
LEFT = SLANT | dict(sensor="left", right=False)
ALL = {"slant": SLANT, "late": LATE, "ground": GROUND, "left": LEFT}


@pytest.fixture(scope="module")
def bound(spark):
    rows = [*ALL.items(), ("broken", SLANT | {"states": states()[:1]})]
    return spark.createDataFrame(rows, f"product string, model {models.MODEL}")


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    rows = [(p, k, float(r), float(x), float(a)) for p in (*ALL, "broken", "unknown") for k, (r, x, a) in enumerate(zip(rng.uniform(0, 7000, 40), rng.uniform(0, 4500, 40), rng.uniform(-50, 3000, 40), strict=True))]
    return spark.createDataFrame(rows, "product string, k int, row double, col double, alt double").repartition(4)


def test_tables_of_many_sensors_go_there_and_back(bound, places, monkeypatch):
    monkeypatch.setattr(models, "PART", 7)
    ground = models.localize(places, bound, ["k", "row", "col", "alt"])
    back = models.project(ground.withColumnsRenamed({"row": "r", "col": "q"}), bound, ["k", "r", "q", "alt"]).toPandas()
    assert len(back) == places.count()
    known = back[back["product"].isin(list(ALL))]
    tolerance = {"slant": 1e-3, "late": 1e-3, "left": 1e-3, "ground": 5e-3}  # the records are no exact inverses of each other
    for p, one in known.groupby("product"):
        assert one["converged"].all() and np.abs(one["row"] - one["r"]).max() < tolerance[p] and np.abs(one["col"] - one["q"]).max() < tolerance[p], p
    assert back[~back["product"].isin(list(ALL))]["row"].isna().all()


def test_one_point_at_a_time_gives_the_same(bound, places):
    ground = models.localize(places, bound, ["k", "row", "col", "alt"]).toPandas()
    one = ground[(ground["product"] == "ground") & (ground["k"] == 5)].iloc[0]
    b = models.Bound(GROUND)
    azt = -10 + one["row"] * 0.002
    k, part = (0, (azt + 10) / 8) if azt < -2 else (1, (azt + 2) / 7)
    rng = 8.5e5 + one["col"] * 10 * (0.6 + (k + part) / 1000)
    m, _ = geometry.on_ellipsoid(b.orbit, np.array([azt]), np.array([rng]), np.array([one["alt"]]))
    assert np.allclose(m[0], one[["x", "y", "z"]].astype(float), atol=1e-6)


def test_lines_of_sight_of_zero_doppler_and_of_a_squint(bound, places):
    ground = models.localize(places.where("product in ('slant', 'late')"), bound, ["k"])
    p = models.line_of_sight(ground.withColumn("doppler", F.when(c("k") % 2 == 0, 0.0).otherwise(c("k") * 37.0 - 700)), bound, ["k", "x", "y", "z", "doppler"]).toPandas()
    assert len(p) == 80 and p["converged"].all()
    for r in p.itertuples():
        orbit = models.Bound(ALL[r.product]).orbit
        point = np.array([r.x, r.y, r.z])
        t = np.linspace(r.azt - 0.05, r.azt + 0.05, 20001)
        d = point - orbit.at(t)
        off = np.abs((orbit.at(t, 1) * d).sum(1) / np.linalg.norm(d, axis=1) - 0.0275 * r.doppler)
        best = t[off.argmin()]
        assert abs(best - r.azt) < 1e-5
        look = (point - orbit.at([best]))[0]
        assert np.allclose(look / np.linalg.norm(look), [r.lx, r.ly, r.lz], atol=1e-6)
        if r.doppler == 0:
            s = orbit.at([geometry.closest_approach(orbit, point[None])[0][0]])[0]
            assert np.allclose((point - s) / np.linalg.norm(point - s), [r.lx, r.ly, r.lz], atol=1e-9)


@pytest.mark.parametrize("axes", [False, True])
def test_predicted_lines_of_sight(bound, places, axes):
    centroid = F.array(F.lit(300.0), F.lit(-0.02))
    fitted = models.sight_polynomials(bound.where("product in ('slant', 'ground')").withColumn("centroid", centroid), 100.0, east_north_up=axes)
    at = places.where("product in ('slant', 'ground')").withColumn("alt", F.lit(100.0))
    ground = models.localize(at, bound, ["k", "row", "col"])
    reach = models.project(ground.withColumnsRenamed({"row": "r", "col": "q"}), bound, ["k", "r", "q", "x", "y", "z"]).select("product", "k", c("r").alias("row"), c("q").alias("col"), "x", "y", "z", (300.0 - 0.02 * (c("rng") - 8.5e5)).alias("doppler"))
    exact = models.line_of_sight(reach, bound, ["k", "row", "col"], axes)
    p = exact.join(fitted.withColumnsRenamed({k: f"p{k}" for k in ("lx", "ly", "lz")}), "product")
    p = p.select("lx", "ly", "lz", *(models.sight(c(f"p{k}"), c("width"), c("height"), c("row"), c("col")).alias(f"s{k}") for k in ("lx", "ly", "lz"))).toPandas()
    assert len(p) == 80 and all(np.abs(p[k] - p[f"s{k}"]).max() < 1e-5 for k in ("lx", "ly", "lz"))
    if axes:
        assert (p["lz"] < 0).all()


def test_parsers_give_models(spark):
    from test_sources import GRD, SLC, texts

    from radarframe.sources import metadata as md

    b = models.of_bursts(md.slc_bursts(texts(spark, SLC))).orderBy("product").collect()
    assert [r.product for r in b] == ["p0#0", "p0#1"] and b[0].model.width == 84 and b[0].model.line_time == 0.5 and b[0].model.states[0].vz == 6
    assert b[0].model.first_rng == pytest.approx((0.0053 + 7 / 6.4e7) * LIGHT_SPEED / 2)
    g = models.of_grd(md.grd_products(texts(spark, GRD))).first()
    assert len(g.model.ground_range) == 2 and g.model.ground_range[1].srgr == [1.0, 1.0] and g.model.range_step == 10
    for df in (b, [g]):
        assert spark.createDataFrame([(1, df[0].model)], f"k int, model {models.MODEL}").count() == 1


RAMP = dict(t0=0.0, dt=0.002, tau0=2 * 8.5e5 / LIGHT_SPEED, dtau=1e-8, mid_tau=2 * 8.55e5 / LIGHT_SPEED, ks=1700.0, fm=[-2300.0, 4e5], fm_tau=2 * 8.5e5 / LIGHT_SPEED, dc=[[-40.0, 3e5]], dc_tau=2 * 8.5e5 / LIGHT_SPEED)
BURSTS = "product string, bsid string, first_azt double, line_time double, first_rng double, range_step double, mid_azt double, bistatic struct<slant_time: double, samples: double, frequency: double>, chirp_rate double, fm_geometry double, ramp " + resampling.RAMP


@pytest.fixture(scope="module")
def burst_rows():
    swath = dict(slant_time=2 * 8.4e5 / LIGHT_SPEED, samples=20000.0, frequency=6.4e7)
    return [(p, f"b{k}", -10.0 + 2.7 * k, 0.002, 8.5e5 + k, 3.0, -8.6 + 2.7 * k, swath, 1e12 if k != 1 else None, -2310.0, RAMP) for p in ("slant", "late") for k in range(3) if (p, k) != ("late", 2)]


def test_secondary_projection_equals_a_loop_over_bursts(spark, bound, burst_rows):
    rng = np.random.default_rng(5)
    k = np.arange(60)
    azt, reach, alt = rng.uniform(-10, -2, 60), rng.uniform(8.5e5, 8.6e5, 60), rng.uniform(0, 2000, 60)
    m, _ = geometry.on_ellipsoid(ORBIT, azt, reach, alt)
    points = spark.createDataFrame(pd.DataFrame({"acquisition": 1, "k": k, "row": (azt + 10) / 0.002, "col": (reach - 8.5e5) / 3, "x": m[:, 0], "y": m[:, 1], "z": m[:, 2], "alt": alt}))
    boxes = spark.createDataFrame([(1, f"b{j}", 0, int(2.7 * j / 0.002), 4000, 1450) for j in range(3)], "acquisition int, bsid string, col int, row int, w int, h int")
    hits = models.in_bursts(points, boxes)
    counts = {r["k"]: r["count"] for r in hits.groupBy("k").count().collect()}
    want = {int(i): sum(2.7 * j <= a + 10 < 2.7 * j + 2.9 for j in range(3)) for i, a in zip(k, azt, strict=True)}
    assert counts == {i: n for i, n in want.items() if n} and 2 in counts.values()
    both = hits.select("*", F.explode(F.array(F.lit("slant"), F.lit("late"))).alias("product"))
    bursts = spark.createDataFrame(burst_rows, BURSTS)
    got = models.secondary_projection(both, bursts, bound, ["k"]).toPandas()
    assert len(got) == sum(n for n in counts.values()) * 2 - hits.where("bsid = 'b2'").count()
    named = {(r[0], r[1]): r for r in burst_rows}
    poly = np.polynomial.polynomial.polyval
    for r in got.itertuples():
        b = models.Bound(ALL[r.product])
        t, s, inc, _ = (v[0] for v in geometry.closest_approach(b.orbit, m[r.k][None]))
        assert abs(t - r.azt0) < 1e-9 and abs(s - r.rng0) < 1e-6
        _, _, first, line, near, step, mid, sw, chirp, geo, ramp = named[r.product, r.bsid]
        tau = 2 * s / LIGHT_SPEED
        fm, f = poly(tau - ramp["fm_tau"], ramp["fm"]), poly(tau - ramp["dc_tau"], ramp["dc"][0])
        late = poly(ramp["mid_tau"] - ramp["dc_tau"], ramp["dc"][0]) / poly(ramp["mid_tau"] - ramp["fm_tau"], ramp["fm"]) - f / fm
        doppler = f + fm * 1700 / (fm - 1700) * (t - mid - late)
        t2 = t - 0.5 * (tau - sw["slant_time"] - 0.5 * sw["samples"] / sw["frequency"]) + doppler * (1 / geo - 1 / fm)
        s2 = s - (doppler / chirp * LIGHT_SPEED / 2 if chirp else 0) + (alt[r.k] ** 2 / 8.55e7 - alt[r.k] / 3411 + 2.41) / np.cos(np.radians(inc))
        assert abs(r.azt - t2) < 1e-9 and abs(r.rng - s2) < 1e-6
        assert abs(r.row - (t2 - first) / line) < 1e-3 and abs(r.col - (s2 - near) / step) < 1e-3
    # and back: without the corrections, then to the ground
    back = spark.createDataFrame(got).join(bursts, ["product", "bsid"]).join(points.select("k", "alt"), "k").withColumn("incidence", F.lit(35.0))
    plain = models.without_corrections(back, ["bistatic", "chirp_rate", "fm_geometry"])
    other = [n for n in models.CORRECTIONS if n != "path_delay"]
    again = models.secondary_projection(both, bursts, bound, ["k"], other)
    p = models.without_corrections(again.join(bursts, ["product", "bsid"]).withColumn("alt", F.lit(0.0)).withColumn("incidence", F.lit(0.0)), other).toPandas()
    assert plain.count() == len(got)
    assert np.abs((p["azt"] - p["azt0"]) / 0.002).max() < 1e-3 and np.abs((p["rng"] - p["rng0"]) / 3).max() < 1e-3
