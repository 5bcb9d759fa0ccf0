"""Resampling through maps, with and without ramps, against images whose values are known everywhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.operators import registration, resampling

TOPS = dict(t0=-0.2, dt=1 / 486.0, tau0=5.3e-3, dtau=1 / 64e6, mid_tau=5.3e-3 + 20 / 64e6, ks=1700.0, fm=[-2300.0, 4e6, 1e10], fm_tau=5.3e-3, dc=[[-40.0, 3e7]], dc_tau=5.3e-3)
STRIP = dict(t0=0.3, dt=0.002, tau0=7e5, dtau=2.0, mid_tau=7e5, ks=None, fm=None, fm_tau=None, dc=[[120.0, 0.02], [30.0, 0.0]], dc_tau=7e5)
MATRIX = [0.998, 0.03, 1.7, -0.02, 1.003, -2.4]
SCHEMA = f"id string, matrix array<double>, rectangle struct<col: int, row: int, w: int, h: int>, ramp {resampling.RAMP}"


def signal(y, x):
    """A band-limited image, known at real places."""
    return np.exp(1j * (0.02 * y - 0.012 * x)) + 0.5 * np.exp(1j * (-0.015 * y + 0.018 * x + 1))


def long(image, **more):
    r, k = np.mgrid[0 : image.shape[0], 0 : image.shape[1]].reshape(2, -1)
    return pd.DataFrame({**more, "row": r, "col": k, "re": image.real.ravel(), "im": image.imag.ravel()})


@pytest.fixture(scope="module")
def got(spark):
    y, x = np.mgrid[0:70, 0:60].astype(float)
    frames = [long(signal(y, x) * np.exp(1j * resampling.ramp_values(r, y, x)), id=k) for k, r in (("tops", TOPS), ("strip", STRIP))] + [long(signal(y, x), id="flat")]
    q = dict(col=-3, row=4, w=60, h=64)
    maps = spark.createDataFrame([("tops", MATRIX, q, TOPS), ("strip", MATRIX, q, STRIP), ("flat", MATRIX, q, None), ("none", MATRIX, q, None), ("singular", [1.0, 1.0, 0.0, 1.0, 1.0, 0.0], q, None)], SCHEMA)
    return resampling.warped(spark.createDataFrame(pd.concat(frames)).repartition(5), maps, ["id"], ["re", "im"], tile=16).toPandas()


@pytest.mark.parametrize("kind", ["tops", "strip", "flat"])
def test_a_resampled_ramp_equals_the_analytic_one(got, kind):
    p = got[got["id"] == kind]
    assert len(p) == 60 * 64 and not p.duplicated(["row", "col"]).any()
    x, y = MATRIX[0] * p["col"] + MATRIX[1] * p["row"] + MATRIX[2], MATRIX[3] * p["col"] + MATRIX[4] * p["row"] + MATRIX[5]
    inside = (y >= 4) & (y < 65) & (x >= 4) & (x < 55)
    outside = (y < 0) | (y > 69) | (x < 0) | (x > 59)
    assert p[inside]["re"].notna().all() and p[outside]["re"].isna().all() and inside.sum() > 2000 and outside.sum() > 50
    ramp = {"tops": TOPS, "strip": STRIP}.get(kind)
    want = signal(y, x) * (np.exp(1j * resampling.ramp_values(ramp, y, x)) if ramp else 1)
    assert np.abs(p["re"] + 1j * p["im"] - want)[inside].max() < 1e-3


def test_a_ramp_left_on_spoils_the_image(spark):
    """What the ramp's removal is for: the same image interpolated as it is."""
    y, x = np.mgrid[0:70, 0:60].astype(float)
    image = long(signal(y, x) * np.exp(1j * resampling.ramp_values(TOPS, y, x)), id="a")
    maps = spark.createDataFrame([("a", [1.0, 0.0, 0.5, 0.0, 1.0, 0.5])], "id string, matrix array<double>")
    p = registration.resampled(spark.createDataFrame(image), maps, ["id"], ["re", "im"], (10, 0, 40, 60)).toPandas().dropna()
    want = signal(p["row"] + 0.5, p["col"] + 10.5) * np.exp(1j * resampling.ramp_values(TOPS, p["row"] + 0.5, p["col"] + 10.5))
    assert np.abs(p["re"] + 1j * p["im"] - want).max() > 0.1


def test_images_without_pixels_or_with_a_singular_map_are_null(got):
    for kind in ("none", "singular"):
        p = got[got["id"] == kind]
        assert len(p) == 60 * 64 and p["re"].isna().all()


def test_columns_and_arrays_give_the_same_ramp(spark):
    y, x = np.mgrid[0:9, 0:7].reshape(2, -1)
    for ramp in (TOPS, STRIP):
        df = spark.createDataFrame(pd.DataFrame({"row": y * 7.5, "col": x * 3.25})).join(spark.createDataFrame([(ramp,)], f"ramp {resampling.RAMP}"))
        p = df.select("row", "col", resampling.ramp_phase(F.col("ramp"), F.col("row"), F.col("col")).alias("f")).toPandas()
        assert np.allclose(p["f"], resampling.ramp_values(ramp, p["row"], p["col"]), rtol=1e-10, atol=1e-9)


@pytest.mark.parametrize("method", ["nearest", "linear", "lanczos"])
def test_whole_shifts_are_exact_up_to_the_border(method):
    image = np.random.default_rng(2).normal(size=(7, 5))
    image[3, 2] = np.nan
    i, j = np.mgrid[-1:8, -1:6]
    want = np.full(i.shape, np.nan)
    want[1:8, 1:6] = image
    assert np.allclose(resampling.interpolated(image, i, j, method), want, equal_nan=True)


def test_real_values_and_methods(spark):
    image = np.random.default_rng(3).normal(size=(20, 20))
    r, k = np.mgrid[0:20, 0:20].reshape(2, -1)
    df = spark.createDataFrame(pd.DataFrame({"id": 1, "row": r, "col": k, "v": image.ravel()}))
    maps = spark.createDataFrame([(1, [1.0, 0.0, 0.25, 0.0, 1.0, 0.5])], "id int, matrix array<double>")
    p = registration.resampled(df, maps, ["id"], ["v"], (0, 0, 18, 18), "linear", tile=5).toPandas().sort_values(["row", "col"])
    rows = 0.5 * (image[:-1] + image[1:])
    assert np.allclose(p["v"].to_numpy().reshape(18, 18), (0.75 * rows[:, :-1] + 0.25 * rows[:, 1:])[:18, :18])


def test_ramps_are_of_complex_images(spark):
    maps = spark.createDataFrame([("tops", MATRIX, dict(col=0, row=0, w=1, h=1), TOPS)], SCHEMA)
    with pytest.raises(ValueError):
        resampling.warped(spark.createDataFrame([("tops", 0, 0, 1.0)], "id string, row int, col int, v double"), maps, ["id"], ["v"])
