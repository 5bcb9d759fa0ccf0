"""Steps whose work must grow no faster than their input, and what they give at its edges."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.functions import roi
from radarframe.operators import geometry, images, joins, kernels, predict, radar, raster
from radarframe.plans import files
from radarframe.plans.dense import circular_orbit
from radarframe.sources import catalog, metadata

c = F.col


def test_footprints_of_many_orbits_are_solved_together(spark):
    """Products of several orbits, one of fewer states, and one whose states lack a number, as if each were alone."""
    first = circular_orbit()
    k = first.coefficients.copy()
    k[0] += [3000.0, -2000.0, 1000.0]
    orbits = [first, geometry.Orbit(first.start, first.end, k)]
    times = [np.linspace(first.start, first.end, n) for n in (17, 5)]
    states = [[tuple(map(float, (s, *o.at([s])[0], *o.at([s], 1)[0]))) for s in t] for o, t in zip(orbits, times, strict=True)]
    holed = [states[0][0], (None, *states[0][1][1:]), *states[0][2:]]
    schema = "id int, states array<struct<t:double,x:double,y:double,z:double,vx:double,vy:double,vz:double>>, first_azt double, azimuth_frequency double, first_rng double, range_step double, w int, h int"
    rows = [(i, states[i % 2], -5.0 + i, 400.0, 850_000.0 + 400 * i, 2.5, 9000, 3000) for i in range(8)]
    df = spark.createDataFrame([*rows, (8, holed, *rows[0][2:])], schema).coalesce(1)
    got = {r["id"]: r["footprint"] for r in predict.coarse_footprints(df).collect()}
    assert len(got) == 9 and got[8] is None
    for i, own, azt0, frequency, rng0, step, w, h in rows:
        s = np.array(own)
        azt, rng = azt0 + np.array([-1000, -1000, h + 1000, h + 1000]) / frequency, rng0 + np.array([-1000, w + 1000, w + 1000, -1000]) * step
        m, done = geometry.on_ellipsoid(geometry.Orbit.fit(s[:, 0], s[:, 1:4], s[:, 4:]), azt, rng, np.array([-1000.0, 9000, 9000, -1000]))
        assert done.all()
        assert np.abs(np.array([(p["lon"], p["lat"]) for p in got[i]]) - geometry.to_geodetic(m)[:, :2]).max() < 1e-9


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_replicated_edges_are_told_once_a_line(spark):
    """No frame that runs from each row to the far end, which takes the square of a column's length; and two windows for all four sums."""
    p = spark.range(60).selectExpr("id div 6 as row", "id % 6 as col", "cast(id * id % 7 as double) as v")
    mean = raster.weighted(p, "v", [0.25, 0.25, 0.25, 0.25, 0.0])
    pair = p.selectExpr("row", "col", "v as r1", "v + 1 as i1", "if(row = 3 and col = 2, null, 2 - v) as r2", "v * v as i2")
    both = images.coherence(pair, 1, 2, "replicate")
    for df in (mean, both):
        assert "currentrow$(), unboundedfollowing" not in _plan(df)
    assert _plan(both).count("window [") == 2 and "join" not in _plan(both)
    a = pair.toPandas().pivot(index="row", columns="col")
    z = {k: a[k].to_numpy(float) for k in ("r1", "i1", "r2", "i2")}
    known = ~np.isnan(z["r2"])
    first, second = z["r1"] + 1j * z["i1"], np.where(known, z["r2"], 0) + 1j * z["i2"]
    box = lambda x: sum(np.pad(np.where(known, x, 0), ((1, 1), (2, 2)), "edge")[i : i + 10, j : j + 6] for i in range(3) for j in range(5)) / 15
    want = np.abs(box(first * second.conj())) / (np.sqrt(box(np.abs(first) ** 2) * box(np.abs(second) ** 2)) + 1e-10)
    got = both.collect()
    assert len(got) == 59 and all(abs(r.coherence - want[r.row, r.col]) < 1e-9 for r in got)


def test_nodes_of_a_height_model_are_not_joined_back(spark):
    """A node's columns go through the projection with it; an image without a size reaches as far as its nodes."""
    dem = spark.createDataFrame([(r, k, float(r * k)) for r in range(3) for k in range(4)], "row long, col long, v double")
    at = dem.select(F.struct("row", "col", "v").alias("id"), (c("row") / 40.0).alias("azt"), (850_000 + 60.0 * c("col")).alias("rng"), F.lit(0.0).alias("alt"))
    dem = geometry.localize(at, circular_orbit()).select("id.row", "id.col", "id.v", "x", "y", "z")
    nodes = radar.image_nodes(dem, circular_orbit(), 0.0, 40.0, 850_000.0, 60.0)
    assert "join" not in _plan(nodes)
    got = {(r.line, r.sample): r.v for r in radar.radarcoded(nodes.withColumns({"line": F.round("line", 6), "sample": F.round("sample", 6)}), "v").collect()}
    assert len(got) == 12 and all(abs(v - line * sample) < 1e-9 for (line, sample), v in got.items())


def test_polygons_that_only_touch_do_not_meet(spark):
    """Borders and corners in common are no overlap; equal polygons, one in the other and shared sides with an overlap are."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    area = box(0.0, 0.0, 10.0, 10.0)
    shapes = {
        "left": box(-3.0, 2.0, 0.0, 4.0), "above": box(2.0, 10.0, 4.0, 12.0), "right": box(10.0, 0.0, 13.0, 10.0), "corner": box(10.0, 10.0, 11.0, 11.0), "far": box(20.0, 0.0, 21.0, 1.0), "slant": [(10.0, 5.0), (15.0, 0.0), (15.0, 9.0)],
        "equal": box(0.0, 0.0, 10.0, 10.0), "half": box(0.0, 0.0, 10.0, 5.0), "in": box(1.0, 1.0, 2.0, 2.0), "around": box(-1.0, -1.0, 11.0, 11.0), "cross": box(-1.0, 4.0, 11.0, 5.0), "over": box(9.99, 9.99, 12.0, 12.0), "turned": list(reversed(area)),
    }
    df = spark.createDataFrame([*shapes.items(), ("none", None)], "name string, f array<struct<lon: double, lat: double>>")
    assert {r.name for r in df.where(catalog.meets("f", area)).collect()} == {"equal", "half", "in", "around", "cross", "over", "turned"}
    notch = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]  # a box in its notch touches two slanted sides
    inside = spark.createDataFrame([("out", [(5.0, 2.0), (10.0, 10.0), (0.0, 10.0)]), ("meets", [(5.0, 1.0), (10.0, 10.0), (0.0, 10.0)])], df.schema)
    assert [r.name for r in inside.where(catalog.meets("f", notch)).collect()] == ["meets"]


def test_a_block_without_an_end_goes_on(spark):
    df = spark.createDataFrame([(k,) for k in (99, 100, 499, 500, 900)], "row long")
    factor = lambda *end: [r[0] for r in df.orderBy("row").select(roi.block_factor(c("row"), F.lit(0), [(100, 500, 0, 4, 1.5, 1.3, *end)])).collect()]
    assert factor() == pytest.approx([1, 1.5, 1.3005, 1, 1]) and factor(None) == pytest.approx([1, 1.5, 1.3005, 1.3, 1.1]) and factor(501) == pytest.approx([1, 1.5, 1.3005, 1.3, 1])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_nearest_records_equal_brute_force(spark, n):
    """Ties, equal times, keys with few records, and points and records without a time; no list of a key's records."""
    rng = np.random.default_rng(n)
    some = [None, float("nan"), *map(float, range(12))]
    records = [(int(k), i, some[int(t)], float(i) / 2) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 90), rng.integers(0, 14, 90), strict=True))] + [(7, 500, 3.0, 1.0), (8, 501, None, 2.0)]
    points = [(i, int(k), some[int(t)] if t < 2 else some[int(t)] + 0.5 * (i % 2)) for i, (k, t) in enumerate(zip(rng.choice([0, 1, 2, 3, 7, 8, 9], 120), rng.integers(0, 14, 120), strict=True))]
    got = joins.nearest_records(spark.createDataFrame(points, "id int, key int, t double"), spark.createDataFrame(records, "key int, idx int, rt double, c0 double").repartition(3), "key", n)
    assert "collect_list" not in _plan(got) or "row_number" in _plan(got)
    found = {r.id: [x.r.idx for x in r.near] for r in got.collect()}
    last = lambda a, b: (1, 0.0) if a is None or b is None or np.isnan(a) or np.isnan(b) else (0, abs(a - b))
    want = {i: [r[1] for r in sorted((r for r in records if r[0] == k), key=lambda r: (*last(r[2], t), r[1]))[:n]] for i, k, t in points}
    assert found == {i: v for i, v in want.items() if v}


def test_annotation_texts_are_parsed_once(spark):
    """Texts without bursts and broken ones give no row, and are not parsed a second time to find out."""
    burst = "<burst><azimuthTime>2021-01-01T00:00:00.5</azimuthTime><firstValidSample>-1 3</firstValidSample><lastValidSample>-1 9</lastValidSample></burst>"
    text = "<product><adsHeader><missionId>S1A</missionId></adsHeader><swathTiming><linesPerBurst>2</linesPerBurst><burstList>{}</burstList></swathTiming></product>"
    df = spark.createDataFrame([("two", text.format(burst * 2)), ("none", text.format("")), ("broken", "<product><swath"), ("null", None)], "path string, text string")
    b = metadata.slc_bursts(df)
    assert _plan(b).count("from_xml") == 1
    assert sorted((r.path, r.burst, r.burst_roi.col, r.burst_roi.row) for r in b.collect()) == [("two", 0, 3, 1), ("two", 1, 3, 3)]


def test_orbit_files_cost_what_their_numbers_do(spark, tmp_path):
    """No object a number, nothing sorted or collected before the shuffle; and lines with nulls, without an order, twice, or between seconds stay."""
    at = datetime.datetime(2000, 1, 1, 0, 0, 0, 250_000)
    rows = [(1, 2, 3, 1, 5.0, 10.5, 0.1, 0.2, at), (1, 2, 3, 2, None, 10.5, 0.1, None, at), (None, 2, 3, 1, 5.0, 10.5, 0.1, 0.2, at), (2, *[None] * 8), (3, 2, 3, 1, 5.0, float("inf"), 0.1, -1e30, None), (1, 2, 3, 1, 5.0, 10.5, 0.1, 0.2, at)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = files.orbit_xml_parse(spark, str(tmp_path))
    assert _plan(df).count("from_xml") == 1 and "_value" not in _plan(df)
    before = df._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert "Aggregate" not in before and "Sort" not in before
    key = lambda r: [(x is not None, x) for x in r]
    want = [(k, None if n is None or t is None else (t - datetime.datetime(1970, 1, 1)).total_seconds() + n, x, y, z, vx, None if vy is None else float(vy), None if vz is None else float(vz)) for k, vy, vz, n, vx, x, y, z, t in rows]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_lines_steeper_than_half_a_turn_are_unwrapped(spark, tmp_path):
    """A surface whose lines turn by more than pi a pixel further down, which no least-cost flow gives back."""
    r, k = np.mgrid[0:48, 0:12].reshape(2, -1)
    f = 0.1 * r + 0.12 * r * k - 0.4 * k
    df = spark.createDataFrame(pd.DataFrame({"row": r, "col": k, "phi": (f + np.pi) % (2 * np.pi) - np.pi}))
    names = iter(range(9))

    def kept(x):
        path = str(tmp_path / f"p{next(names)}")
        x.write.parquet(path)
        return spark.read.parquet(path)

    got = kernels.unwrapped_steep(df, kept, 8).toPandas().sort_values(["row", "col"])
    u = got["unwrapped"].to_numpy()
    assert len(u) == len(f) and np.abs(u - u[0] - (f - f[0])).max() < 1e-9
