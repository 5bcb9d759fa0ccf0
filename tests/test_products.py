"""Registration, resampling, refinement and slice normalisation against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.operators import kernels, pipelines, registration

c = F.col


def test_affines_equal_the_direct_solution_and_null_where_there_is_none(spark):
    rng = np.random.default_rng(5)
    src = rng.uniform(0, 1000, (400, 2))
    dst = src @ np.array([[1.001, 0.02], [-0.015, 0.998]]).T + [12.0, -7.0] + rng.normal(0, 0.05, (400, 2))
    df = pd.DataFrame({"id": 1, "col": src[:, 0], "row": src[:, 1], "to_col": dst[:, 0], "to_row": dst[:, 1]})
    line = pd.DataFrame({"id": 2, "col": [0.0, 1, 2], "row": [0.0, 1, 2], "to_col": [1.0, 2, 3], "to_row": [0.0, 1, 2]})
    few = pd.DataFrame({"id": 3, "col": [0.0], "row": [0.0], "to_col": [1.0], "to_row": [0.0]})
    hole = pd.DataFrame({"id": 1, "col": [5.0], "row": [np.nan], "to_col": [1.0], "to_row": [0.0]})
    got = {r["id"]: r["matrix"] for r in registration.affines(spark.createDataFrame(pd.concat([df, line, few, hole])).repartition(3), ["id"]).collect()}
    assert np.allclose(np.array(got[1]).reshape(2, 3), kernels.total_least_squares(src, dst), atol=1e-6)
    assert got[2] is None and got[3] is None


def test_resampling_and_refinement_find_the_shift(spark):
    rng = np.random.default_rng(6)
    image = rng.normal(size=(64, 64))  # the peak's sinc law holds for a full band
    r, k = np.mgrid[0:64, 0:64].reshape(2, -1)
    primary = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "amp": image.ravel()}))
    moved = np.roll(image, (3, -5), (0, 1))
    secondary = spark.createDataFrame(pd.DataFrame({"id": 1, "row": r, "col": k, "amp": moved.ravel()}))
    found = registration.shifts(primary, secondary, ["id"]).collect()[0]
    assert (round(found["d_col"], 2), round(found["d_row"], 2)) == (-5.0, 3.0)
    maps = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "id int, matrix array<double>")
    maps = registration.shifted(maps, registration.shifts(primary, secondary, ["id"]), ["id"])
    got = registration.resampled(secondary, maps, ["id"], ["amp"], (10, 12, 20, 15)).toPandas()
    assert len(got) == 300 and np.allclose(got["amp"], image[got["row"] + 12, got["col"] + 10], atol=1e-3)


def test_interferograms_are_filtered_after_their_looks(spark):
    rng = np.random.default_rng(10)
    z = {d: rng.normal(size=(64, 96)) + 1j * rng.normal(size=(64, 96)) for d in "abc"}
    r, k = np.mgrid[0:64, 0:96].reshape(2, -1)
    images = spark.createDataFrame(pd.concat([pd.DataFrame({"date": d, "row": r, "col": k, "re": v.real.ravel(), "im": v.imag.ravel()}) for d, v in z.items()]))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "date1 string, date2 string")
    got = pipelines.interferograms(images, pairs, looks=(2, 4), goldstein=(4, 3, 0.6)).toPandas()
    plain = pipelines.interferograms(images, pairs, looks=(2, 4)).toPandas()
    assert len(got) == len(plain) == 2 * 32 * 24
    for d in "bc":
        mean = (z["a"] * z[d].conj()).reshape(32, 2, 24, 4).mean((1, 3))
        want = kernels.goldstein(mean, 4, 3, 0.6)
        one = got[got["date2"] == d]
        assert np.allclose(one["re"] + 1j * one["im"], want[one["row"], one["col"]], atol=1e-9)
    both = got.merge(plain, on=["date1", "date2", "row", "col"])
    assert (both["coherence_x"] == both["coherence_y"]).all()


def test_peaks_that_cant_be_trusted_are_refused(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(48, 40))
    moved, twice, noise = np.roll(a, (5, -3), (0, 1)), np.roll(a, (5, -3), (0, 1)) + np.roll(a, (-9, 6), (0, 1)), rng.normal(size=a.shape)
    assert np.allclose(kernels.guarded_shift(a, moved, 0.5, 0.7, 10)[:2], (5, -3), atol=0.02)
    assert kernels.guarded_shift(a, moved) == kernels.correlation_shift(a, moved)
    assert np.isnan(kernels.guarded_shift(a, twice, most_second=0.7)).all() and not np.isnan(kernels.guarded_shift(a, twice)).any()
    assert np.isnan(kernels.guarded_shift(a, noise, least=0.5)).all() and np.isnan(kernels.guarded_shift(a, moved, least=0.5, max_shift=4)).all()
    r, k = np.mgrid[0:48, 0:40].reshape(2, -1)
    frame = lambda z, **m: pd.DataFrame({**m, "row": r, "col": k, "amp": z.ravel()})
    both = spark.createDataFrame(pd.concat([frame(z, id=i) for i, z in enumerate((moved, twice, noise))]))
    got = {x.id: x for x in registration.shifts(spark.createDataFrame(frame(a)), both, ["id"], least=0.3, most_second=0.7).collect()}
    assert round(got[0].d_row) == 5 and round(got[0].d_col) == -3 and got[1].d_row is None and got[2].peak is None


def test_an_image_without_a_map_is_null(spark):
    maps = spark.createDataFrame([(1, None)], "id int, matrix array<double>")
    image = spark.createDataFrame([(1, 0, 0, 1.0)], "id int, row int, col int, amp double")
    got = registration.resampled(image, maps, ["id"], ["amp"], (0, 0, 3, 2)).collect()
    assert len(got) == 6 and all(r["amp"] is None for r in got)


def test_ground_sample_is_a_share_and_does_not_depend_on_partitions(spark):
    dem = spark.range(20000).select((c("id") / 100).cast("int").alias("row"), (c("id") % 100).alias("col"), F.when(c("id") % 10 > 0, 1.0).alias("alt"))
    a = registration.ground_sample(dem, 0.1)
    assert 1600 < a.count() < 2000
    assert a.exceptAll(registration.ground_sample(dem.repartition(7), 0.1)).count() == 0
    assert registration.ground_sample(dem, 1.0).count() == 18000


def test_lines_belong_to_the_first_slice_and_others_stay(spark):
    r, k = np.mgrid[0:12, 0:4].reshape(2, -1)
    image = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "amp": 2.0}))
    slices = spark.createDataFrame([(0, 0.0, 0.0, 4, 5), (1, 0.0, 3.0, 3, 6)], "slice_id int, dx double, dy double, w int, h int")
    sim = [(0, i, j, 4.0) for i in range(5) for j in range(4)] + [(1, i, j, 0.04 if i == 2 else 1.0) for i in range(6) for j in range(3)]
    got = pipelines.normalized_by_slices(image, slices, spark.createDataFrame(sim, "slice_id int, row int, col int, v double")).toPandas().set_index(["row", "col"]).sort_index()
    assert len(got) == 48
    assert all(got.loc[(i, j), "slice_id"] == 0 and got.loc[(i, j), "amp"] == 1.0 for i in range(4) for j in range(4))
    assert got.loc[(4, 0), "amp"] == 2.0 and got.loc[(4, 0), "slice_id"] == 1 and got.loc[(5, 0), "amp"] == 0.0
    assert np.isnan(got.loc[(4, 3), "slice_id"]) and got.loc[(4, 3), "amp"] == 2.0
    assert got.loc[8:, "slice_id"].isna().all() and (got.loc[8:, "amp"] == 2.0).all()


def test_slice_ids_of_an_image(spark):
    df = spark.createDataFrame([(100.5, 103.0, 100.0)], "a double, b double, anx double")
    assert df.select(pipelines.slices_between(c("a"), c("b"), c("anx"), 1.0).alias("s")).first()["s"] == [0, 1, 2]


def test_a_crop_of_two_datatakes_fails(spark):
    schema = "datatake int, row int, col int, dn double, noise double, factor double"
    at = spark.createDataFrame([(0, 0, 0.0, 0.0)], "row int, col int, y double, x double")
    one = pipelines.ground_range_crop(spark.createDataFrame([(1, 0, 0, 3.0, 1.0, 2.0)], schema), at, nearest=True)
    assert one.collect()[0]["sigma"] == 2.0
    two = spark.createDataFrame([(1, 0, 0, 3.0, 1.0, 2.0), (2, 0, 1, 3.0, 1.0, 2.0)], schema)
    with pytest.raises(Exception, match="several datatakes"):
        pipelines.ground_range_crop(two, at, nearest=True).collect()


def test_tiles_are_unwrapped_and_joined_like_the_whole(spark, tmp_path):
    y, x = np.mgrid[0:50, 0:61]
    truth = 0.2 * y + 0.15 * x + 6 * np.exp(-((y - 20) ** 2 + (x - 30) ** 2) / 200)
    truth += np.random.default_rng(7).normal(0, 0.3, truth.shape)
    frames = [pd.DataFrame({"id": k, "row": y.ravel(), "col": x.ravel(), "phi": kernels.wrapped(truth * s).ravel()}) for k, s in ((1, 1.0), (2, -1.0))]
    frames[0].loc[5, "phi"] = np.nan
    kept = lambda df: df.cache()
    got = kernels.unwrapped_raster(spark.createDataFrame(pd.concat(frames)), kept, 16, ["id"]).toPandas()
    assert len(got) == 2 * truth.size
    for k, s in ((1, 1.0), (2, -1.0)):
        u = got[(got["id"] == k) & got["unwrapped"].notna()]
        off = (u["unwrapped"] - s * truth[u["row"], u["col"]]) / (2 * np.pi)
        assert np.abs(off - np.rint(off)).max() < 1e-9
        assert (np.rint(off) == np.rint(off).mode()[0]).mean() > 0.99
    assert got[(got["id"] == 1) & (got["row"] == 0) & (got["col"] == 5)]["unwrapped"].isna().all()


def test_crops_are_refined_onto_the_primary(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(80, 80)) + 1j * rng.normal(size=(80, 80))
    r, k = np.mgrid[0:80, 0:80].reshape(2, -1)
    moved = np.roll(z, (4, 7), (0, 1))  # the map below knows of (2, 7)
    rows = pd.concat([pd.DataFrame({"product": p, "row": r, "col": k, "re": a.real.ravel(), "im": a.imag.ravel()}) for p, a in (("a", z), ("b", moved))])
    maps = spark.createDataFrame([("b", [1.0, 0.0, 7.0, 0.0, 1.0, 2.0])], "product string, matrix array<double>")
    got = registration.crops(spark.createDataFrame(rows), maps, "a", (8, 8, 64, 64), lambda df: df.cache()).toPandas()
    assert len(got) == 2 * 64 * 64
    a, b = (got[got["product"] == p].sort_values(["row", "col"])[["re", "im"]].to_numpy() for p in "ab")
    near = np.abs(a - b).reshape(64, 64, 2)[8:56, 8:56]
    assert np.nanmean(near) < 0.1


def test_time_series_has_whole_dates_only_on_the_primary_grid(spark):
    from radarframe.operators import bursts

    cuts = bursts.cut(spark.createDataFrame([("p", "iw1", k, 0, k * 8, 6, 10, k * 8.0, k * 8.0 + 10) for k in range(2)], "acquisition string, swath string, burst int, col int, row int, w int, h int, start double, end double"), 1.0)
    rows = [(d, "iw1", b, r, k, 100.0 * (b * 8 + r - s) + k, float(b)) for d, s in (("d1", 0), ("d2", 1), ("d3", 0)) for b in range(1 if d == "d3" else 2) for r in range(12) for k in range(6)]
    pixels = spark.createDataFrame(rows, "date string, swath string, burst int, row int, col int, re double, im double")
    maps = spark.createDataFrame([(d, "iw1", b, [1.0, 0.0, 0.0, 0.0, 1.0, s]) for d, s in (("d2", 1.0), ("d3", 0.0)) for b in range(2)], "date string, swath string, burst int, matrix array<double>")
    got = pipelines.time_series(pixels, cuts, maps, "d1", (1, 2, 4, 14)).toPandas()
    assert set(got["date"]) == {"d1", "d2"} and len(got) == 2 * 4 * 14
    assert (got["re"] == 100.0 * (got["row"] + 2) + got["col"] + 1).all()
    assert not got.duplicated(["date", "row", "col"]).any()


def test_matches_of_an_orbit_with_itself_are_the_same_places(spark):
    from radarframe.operators import geometry
    from radarframe.plans.dense import circular_orbit

    orbit = circular_orbit()
    azt, rng = np.linspace(-5, 5, 40), np.linspace(850_000, 870_000, 40)
    ground = geometry.on_ellipsoid(orbit, azt, rng, np.zeros(40))[0]
    dem = spark.createDataFrame(pd.DataFrame({"row": range(40), "col": 0, "x": ground[:, 0], "y": ground[:, 1], "z": ground[:, 2]}))
    got = registration.matches(dem, orbit, {"b": orbit}, {"a": (-5.0, 100.0, 850_000.0, 10.0), "b": (-6.0, 100.0, 849_000.0, 10.0)}, "a").toPandas()
    assert len(got) == 40 and np.allclose(got["to_row"] - got["row"], 100, atol=1e-3) and np.allclose(got["to_col"] - got["col"], 100, atol=1e-3)


def search_backend(query):
    return [{"name": f"p{int(t)}", "t": float(t)} for t in range(100) if query["start"] <= t < query["end"]]


def test_catalogue_source_asks_by_interval(spark):
    from radarframe.sources import backend

    backend.register(spark)
    read = spark.read.format("radar_catalog").option("backend", "tests.test_products:search_backend").option("query", '{"start": 10, "end": 50}').option("parts", "4")
    names = read.load()
    assert names.columns == ["name"] and names.count() == 40
    df = read.schema("name string, t double").load()
    assert sorted(r["t"] for r in df.collect()) == list(range(10, 50))
