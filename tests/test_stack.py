"""Bursts, corrections, geometry prediction, orthorectification, splines, GeoTIFF and stores against invariants and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import bursts, correction, geometry, ortho, predict, spline
from radarframe.plans.dense import circular_orbit
from radarframe.sources import store, tiff

c = F.col


def test_utm_known_place_and_round_trip(spark):
    df = spark.createDataFrame([(-79.387139, 43.642566, 17), (2.2945, 48.8583, 31), (151.2153, -33.8568, 56)], "lon double, lat double, zone int")
    east, north = phase.utm(c("lon"), c("lat"), c("zone"))
    df = df.select("*", east.alias("e"), north.alias("n"))
    lon, lat = phase.from_utm(c("e"), c("n"), c("zone"), c("lat") < 0)
    got = df.select("*", lon.alias("lon2"), lat.alias("lat2")).toPandas()
    assert abs(got["e"][0] - 630084) < 1 and abs(got["n"][0] - 4833438) < 1
    assert np.abs(got["lon"] - got["lon2"]).max() < 1e-8 and np.abs(got["lat"] - got["lat2"]).max() < 1e-8
    assert got["n"][2] > 5e6


def test_node_correction_moves_only_bursts_after_the_node(spark):
    orbit = bursts.T_ORBIT
    rows = [(100.0, 90.0, 4.5, 1), (orbit + 200, orbit + 100, 4.5, 1), (orbit + 5, orbit + 1, 4.5, 1), (orbit + 5, orbit + 1, 150.0, 1), (orbit + 100, orbit + 1, 150.0, 1), (None, orbit + 1, 4.5, 1)]
    df = spark.createDataFrame(rows, "anx double, first double, lon double, rel int").select(bursts.node_correction(c("anx"), c("first"), c("lon"), c("rel")).alias("d"))
    got = [r["d"] for r in df.collect()]
    assert got[0] == 0 and got[1] == got[2] == got[4] == -orbit and got[3] == 0


def test_cuts_cover_each_line_of_a_swath_once(spark):
    f = 486.0
    rows = [("a", "iw1", k, 3, k * 1340, 500, 1480, k * 1340 / f, (k * 1340 + 1480) / f) for k in range(4)]
    cut = bursts.cut(spark.createDataFrame(rows, "acquisition string, swath string, burst int, col int, row int, w int, h int, start double, end double"), f)
    got = cut.orderBy("burst").toPandas()
    lines = [(r["row"] + r["inner"]["row"], r["row"] + r["inner"]["row"] + r["inner"]["h"]) for _, r in got.iterrows()]
    assert lines[0][0] == 0 and lines[-1][1] == 3 * 1340 + 1480
    assert all(a[1] == b[0] for a, b in zip(lines, lines[1:]))
    assert all(r["inner"]["col"] == 0 and r["inner"]["w"] == 500 for _, r in got.iterrows())
    parts = bursts.stitched(cut, (3, 700, 100, 1500)).toPandas()
    written = sorted((r["write"]["row"], r["write"]["row"] + r["write"]["h"]) for _, r in parts.iterrows())
    assert written[0][0] == 0 and written[-1][1] == 1500 and all(a[1] == b[0] for a, b in zip(written, written[1:]))
    assert bursts.stitched(cut, (5000, 0, 10, 10)).count() == 0


def test_corrections_are_estimated_on_the_initial_point_and_invert(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None)], "azt double, rng double")
    chain = [correction.constant(rng=5.0), lambda: {"rng": c("rng") * 0.1, "azt": c("rng")}]
    out = correction.corrected(df, chain).collect()
    assert (out[0]["azt"], out[0]["rng"]) == (11.0, 16.0) and out[1]["rng"] is None
    back = correction.corrected(df, chain, inverse=True).collect()[0]
    assert (back["azt"], back["rng"]) == (-9.0, 4.0)
    assert correction.corrected(df, []).columns == ["azt", "rng"]


def _moved(orbit, by):
    k = orbit.coefficients.copy()
    k[0] += by
    return geometry.Orbit(orbit.start, orbit.end, k)


def test_predictor_meets_the_solved_geometry(spark):
    orbit, timing = circular_orbit(), predict.Timing(-20.0, 40.0, 850_000.0, 60.0, 640, 1600)
    other = _moved(orbit, [120.0, -80.0, 50.0])
    p = predict.Predictor.fit(orbit, timing, [other])
    rng = np.random.default_rng(1)
    rows, cols = rng.uniform(0, 1599, 200), rng.uniform(0, 639, 200)
    exact = predict.configuration(orbit, timing, [other], rows, cols)
    df = spark.createDataFrame(pd.DataFrame({"row": rows, "col": cols}))
    got = df.select("row", *(p.column(k, c("row"), c("col")).alias(k) for k in exact)).toPandas()
    order, mine = np.argsort(rows), np.argsort(got["row"].to_numpy())
    for k, v in exact.items():
        assert np.abs(got[k].to_numpy()[mine] - v[order]).max() < 1e-5, k


def test_footprints_enclose_the_image_and_keep_null_rows(spark):
    orbit = circular_orbit()
    t = np.linspace(orbit.start, orbit.end, 17)
    states = [tuple(map(float, (s, *orbit.at([s])[0], *orbit.at([s], 1)[0]))) for s in t]
    schema = "id int, states array<struct<t:double,x:double,y:double,z:double,vx:double,vy:double,vz:double>>, first_azt double, azimuth_frequency double, first_rng double, range_step double, w int, h int"
    df = spark.createDataFrame([(1, states, -5.0, 400.0, 850_000.0, 2.5, 9000, 3000), (2, None, 0.0, 400.0, 850_000.0, 2.5, 9000, 3000), (3, states, -5.0, 400.0, None, 2.5, 9000, 3000)], schema)
    got = {r["id"]: r for r in predict.bounds(predict.coarse_footprints(df)).collect()}
    assert set(got) == {1, 2, 3} and got[2]["lon_min"] is None and got[3]["lon_min"] is None
    timing = predict.Timing(-5.0, 400.0, 850_000.0, 2.5, 9000, 3000)
    azt, rng = timing.at(np.array([0.0, 1500, 3000, 0]), np.array([0.0, 4500, 9000, 9000]))
    for alt in (0.0, 3000.0):
        place = geometry.to_geodetic(geometry.on_ellipsoid(orbit, azt, rng, np.full(4, alt))[0])
        assert (place[:, 0] > got[1]["lon_min"]).all() and (place[:, 0] < got[1]["lon_max"]).all()
        assert (place[:, 1] > got[1]["lat_min"]).all() and (place[:, 1] < got[1]["lat_max"]).all()


def test_ortho_gives_back_a_plane_and_null_outside(spark):
    r, k = np.mgrid[0:12, 0:15].reshape(2, -1)
    nodes = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "line": 2.0 * r + 1, "sample": 1.5 * k}))
    grid = spark.createDataFrame([(0, 0, 3.25, 4.5), (0, 1, 11.0, 14.0), (0, 2, 11.5, 3.0), (0, 3, None, 1.0)], "row int, col int, y double, x double")
    got = {x["col"]: (x["y"], x["x"]) for x in ortho.coordinate_map(nodes, grid, (1.0, 0.0), (2.0, 1.0)).collect()}
    assert got[0] == (3.25, 6.75) and got[1] == (11.0, 21.0) and got[2] == (None, None) and got[3] == (None, None)
    r, k = np.mgrid[0:20, 0:30].reshape(2, -1)
    image = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "v": 10.0 * r + k}))
    at = spark.createDataFrame([(0, 0, 3.25, 6.75), (0, 1, 19.0, 29.0), (0, 2, -0.5, 3.0)], "row int, col int, y double, x double")
    assert {x["col"]: x["v"] for x in ortho.pulled(image, at, ["v"]).collect()} == {0: 39.25, 1: 219.0, 2: None}
    assert {x["col"]: x["v"] for x in ortho.pulled(image, at, ["v"], nearest=True).collect()} == {0: 37.0, 1: 219.0, 2: 3.0}
    assert ortho.aligned_grid(3, 4, 27, 31, 10) == (0, 40, 3, 4)
    with pytest.raises(ValueError):
        ortho.aligned_grid(0, 0, 1, 1, 10, 15)


def test_spline_meets_a_smooth_surface_and_equals_a_direct_fit(spark):
    rng = np.random.default_rng(2)
    y, x = rng.uniform(0, 79, 900), rng.uniform(0, 99, 900)
    truth = lambda a, b: np.sin(a / 25) + 0.5 * np.cos(b / 30)
    noisy = truth(y, x) + rng.normal(0, 0.05, 900)
    df = spark.createDataFrame(pd.DataFrame({"date": 1, "row": y, "col": x, "value": noisy, "weight": 20.0})).repartition(3)
    fit = spline.fitted(df, 80, 100).collect()[0]
    assert abs(fit["misfit"] - (900 - np.sqrt(1800))) < 5
    surface = spline.evaluated(spline.fitted(df, 80, 100), 80, 100).toPandas()
    assert len(surface) == 8000
    error = surface["value"] - truth(surface["row"].to_numpy(), surface["col"].to_numpy())
    assert np.sqrt((error**2).mean()) < 0.03
    (a, fa), (b, fb) = spline.basis(y / 79, 10), spline.basis(x / 99, 10)
    m = np.zeros((900, 169))
    for n in range(900):
        for i in range(4):
            m[n, (a[n] + i) * 13 + b[n] : (a[n] + i) * 13 + b[n] + 4] += fa[n, i] * fb[n]
    free = np.linalg.lstsq(m * 20, noisy * 20, rcond=None)[0]
    closest = spline.fitted(df, 80, 100, smoothing=0.0).collect()[0]
    assert abs(closest["misfit"] - (((m @ free - noisy) * 20) ** 2).sum()) < 1e-3


def test_atmosphere_of_a_date_without_points_is_its_plane(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, None, 1.0)], "date int, row double, col double, value double, weight double")
    planes = spark.createDataFrame([(2, 1.0, 0.5, 0.25)], "date int, a double, by_row double, by_col double")
    got = spline.atmosphere(p, planes, 3, 4).toPandas()
    assert len(got) == 12 and np.allclose(got["value"], 1 + 0.5 * got["row"] + 0.25 * got["col"])


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32", "complex64"])
def test_tiff_round_trip(kind):
    rng = np.random.default_rng(3)
    z = (rng.normal(size=(300, 517)) * 100 + 120).clip(0, 250).astype(kind)
    if kind == "complex64":
        z += 1j * rng.normal(size=z.shape).astype("f4")
    data = tiff.encoded(z, tile=128, origin=(5e5, 4e6), resolution=10.0, epsg=32631)
    assert (tiff.window(data) == z).all()
    assert (tiff.window(data, 100, 120, 200, 77) == z[120:197, 100:300]).all()
    assert (tiff.window(data, 500, 290, 200, 77) == z[290:, 500:]).all() and tiff.window(data, 600, 0, 5, 5).size == 0
    t = tiff.tags_of(data)
    assert t[tiff.TIE_POINT][3:5] == [5e5, 4e6] and t[tiff.GEO_KEYS][-1] == 32631
    with pytest.raises(ValueError):
        tiff.window(b"XX\0*" + data[4:])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("kind", "compression", "predictor", "planar", "tile"), [
    ("uint8", "lzw", 1, False, 64), ("uint16", "lzw", 2, False, None), ("int32", "deflate", 2, True, 48), ("float32", "lzw", 3, True, None), ("float64", "deflate", 3, False, 32), ("int16", "none", 2, False, 32), ("complex64", "none", 1, True, None),
])
def test_tiff_of_several_bands(kind, compression, predictor, planar, tile, order, big):
    rng = np.random.default_rng(4)
    z = (rng.normal(size=(101, 77, 3)).cumsum(1) * 50).astype(kind) if kind != "complex64" else (rng.normal(size=(101, 77, 3)) + 1j).astype(kind)
    data = tiff.encoded(z, tile, compression=compression, predictor=predictor, planar=planar, order=order, big=big, rows_per_strip=16)
    assert tiff.tags_of(data)[tiff.ORDER] == order and (tiff.window(data) == z).all()
    assert (tiff.window(data, 30, 40, 25, 50) == z[40:90, 30:55]).all() and (tiff.window(data, 30, 40, 25, 50, band=2) == z[40:90, 30:55, 2]).all()
    assert tiff.window(data, 70, 95, 50, 50, band=1).shape == (6, 7)


def test_lzw_codes_grow_and_start_again():
    rng = np.random.default_rng(1)
    for raw in (b"", b"a", b"a" * 5000, rng.integers(0, 256, 40_000).astype("u1").tobytes(), rng.integers(0, 4, 60_000).astype("u1").tobytes()):
        assert tiff.lzw_unpacked(tiff.lzw_packed(raw)) == raw
    # the first codes of the format's own example: clear, 7, 258, 8, 8, 258, 6, 6, end, of nine bits each
    packed = "".join(f"{b:08b}" for b in tiff.lzw_packed(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))
    assert [int(packed[k : k + 9], 2) for k in range(0, 81, 9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


def test_a_window_of_a_planar_file_reads_its_blocks_only():
    z = np.arange(200 * 200 * 2, dtype="f4").reshape(200, 200, 2)
    data = bytearray(tiff.encoded(z, 50, planar=True, compression="none"))
    t = tiff.tags_of(bytes(data))
    for k, at in enumerate(t[tiff.TILES]):
        if k not in (16 + 5, 16 + 6):  # the second band's blocks of the window
            data[at : at + 8] = b"\xff" * 8
    assert (tiff.window(bytes(data), 60, 60, 80, 30, band=1) == z[60:90, 60:140, 1]).all()


def test_tiff_files_on_disk(spark, tmp_path):
    r, k = np.mgrid[0:90, 0:70].reshape(2, -1)
    df = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "re": r * 1.0, "im": k * 1.0}))
    tiff.save(tiff.files(df, ("re", "im"), size=64, kind="complex64"), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0_0.tif", "0_1.tif", "1_0.tif", "1_1.tif"]
    got = tiff.read(spark, f"file://{tmp_path}/out/0_0.tif", rectangle=(3, 4, 10, 6)).toPandas()
    assert len(got) == 60 and np.allclose(got["value"], np.hypot(got["row"], got["col"]))


def test_store_makes_each_key_once(spark, tmp_path):
    made = []

    def make(keys):
        made.append(sorted((r["k"] is None, r["k"] or 0) for r in keys.collect()))
        return keys.withColumn("v", c("k") * 2)

    path = f"file://{tmp_path}/slices"
    want = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert store.get_or_make(spark, path, want(1, 2, 2), ["k"], make).count() == 2
    assert sorted(r["v"] for r in store.get_or_make(spark, path, want(2, 3), ["k"], make).collect()) == [4, 6]
    store.get_or_make(spark, path, want(None, 1), ["k"], make)
    assert store.get_or_make(spark, path, want(None), ["k"], make).count() == 1
    assert made == [[(False, 1), (False, 2)], [(False, 3)], [(True, 0)], []]
    assert store.stored(spark, f"file://{tmp_path}/nothing") is None


def test_layout_of_images_and_missing_simulations(spark, tmp_path):
    root = f"file://{tmp_path}/stack"
    image = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.5)], "row int, col int, v double")
    for d in ("2024-01-01", "2024-01-13"):
        store.put_image(image, root, "imgs", d)
    store.put_image(image.select("row", "col", c("v").alias("flat")), root, "flat", "2024-01-13")
    assert store.dates(spark, root).count() == 3
    images = spark.read.parquet(f"{root}/kind=imgs")
    got = store.stacked(images, spark.read.parquet(f"{root}/kind=flat")).toPandas()
    assert len(got) == 4 and got.loc[got["date"].astype(str) == "2024-01-01", "flat"].isna().all() and got["flat"].notna().sum() == 2


def test_bursts_get_numbers_and_names(spark):
    orbit = bursts.T_ORBIT
    place = [{"lon": 4.0, "lat": 1.0}, {"lon": 5.0, "lat": 1.0}]
    rows = [("p", k, "iw1", orbit + 300 + k * 2.75, 1e9 + orbit + 300 + k * 2.75, 1e9, 1, 1 + 175, 1500, 0.0005, place) for k in range(3)]
    df = spark.createDataFrame(rows, "path string, burst int, swath string, azimuth_anx_time double, burst_sensing_time double, anx_time double, relative_orbit_number int, absolute_orbit_number int, lines_per_burst int, pri double, approx_geom array<struct<lon: double, lat: double>>")
    got = bursts.numbered(df).orderBy("burst").collect()
    mid = [300 + k * 2.75 + 0.0005 * 1499 / 2 for k in range(3)]
    assert [r["relative_burst_id"] for r in got] == [1 + int((m - phase.T_PREAMBLE) // phase.T_BEAM) for m in mid]
    assert [r["absolute_burst_id"] - r["relative_burst_id"] for r in got] == [phase.CYCLE_BURSTS] * 3
    assert got[0]["bsid"] == f"{got[0]['relative_burst_id']}_iw1"
