"""Queries over rectangles, grids, phase models, fits, height models, catalogue searches and parsers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from radarframe.functions import models, roi
from radarframe.operators import fits, geometry, kernels
from radarframe.plans.catalogue import query, table
from radarframe.plans.dense import _A, _RATE, _TILT, circular_orbit, small_images
from radarframe.plans.pixels import POINTS, points
from radarframe.plans.series import DAILY, daily
from radarframe.sources import catalog, dem, metadata

c = F.col
_R = F.round


@query(
    """WITH r AS (SELECT p_partkey AS id, p_partkey % 50 - 10 AS col, CAST(p_size AS BIGINT) - 5 AS row, p_partkey % 30 + 1 AS w, CAST(p_size AS BIGINT) AS h FROM part),
    k AS (SELECT *, greatest(col, 0) AS c0, greatest(row, 0) AS r0, least(col + w, 40) - greatest(col, 0) AS cw, least(row + h, 30) - greatest(row, 0) AS rh FROM r),
    m AS (SELECT *, least(1.5 * col + 0.1 * row, 1.5 * col + 0.1 * (row + h - 1)) - 2.25 AS x0, greatest(1.5 * (col + w - 1) + 0.1 * row, 1.5 * (col + w - 1) + 0.1 * (row + h - 1)) - 2.25 AS x1,
      0.9 * row - 0.2 * (col + w - 1) + 4.5 AS y0, 0.9 * (row + h - 1) - 0.2 * col + 4.5 AS y1 FROM k)
    SELECT id, col - 3 AS m_col, row - 2 AS m_row, w + 6 AS m_w, h + 4 AS m_h, CASE WHEN cw > 0 AND rh > 0 THEN c0 ELSE 0 END AS v_col, CASE WHEN cw > 0 AND rh > 0 THEN r0 ELSE 0 END AS v_row,
    CASE WHEN cw > 0 AND rh > 0 THEN cw ELSE 0 END AS v_w, CASE WHEN cw > 0 AND rh > 0 THEN rh ELSE 0 END AS v_h,
    CAST(floor(round(x0, 9)) AS BIGINT) AS w_col, CAST(floor(round(y0, 9)) AS BIGINT) AS w_row, CAST(ceil(round(x1, 9)) - floor(round(x0, 9)) AS BIGINT) + 1 AS w_w, CAST(ceil(round(y1, 9)) - floor(round(y0, 9)) AS BIGINT) + 1 AS w_h FROM m"""
)
def roi_algebra(spark, sf_dir):
    """Margins, the valid part and a warp of rectangles."""
    k, h = c("p_partkey"), c("p_size")
    r = table(spark, sf_dir, "part").select(k.alias("id"), roi.roi(k % 50 - 10, h - 5, k % 30 + 1, h).alias("r"))
    exact = F.struct(*(c(f"r.{n}").cast("decimal(20,4)").alias(n) for n in ("col", "row", "w", "h")))
    done = r.select("id", roi.with_margin(c("r"), 3, 2).alias("m"), roi.made_valid(c("r"), 40, 30).alias("v"), exact.alias("e"))
    done = done.withColumn("w", roi.warped(c("e"), *(F.lit(v).cast("decimal(10,2)") for v in ("1.5", "0.1", "-2.25", "-0.2", "0.9", "4.5"))))
    return done.select("id", *(c(f"{p}.{n}").alias(f"{p}_{n}") for p in "mvw" for n in ("col", "row", "w", "h")))


_MAP = (0.5, 0.01, 100.0, 0.02, -0.25, 50.0)


@query(
    """WITH g AS (SELECT n_nationkey AS id, unnest(range(10 + n_nationkey)) AS r, 12 + n_nationkey % 5 AS w FROM nation), p AS (SELECT id, r, unnest(range(w)) AS k FROM g)
    SELECT id, r AS row, k AS col, round(CAST(0.5 * (k + 0.5) + 0.01 * (r + 0.5) + 100 + id AS DOUBLE), 6) AS x, round(CAST(0.02 * (k + 0.5) - 0.25 * (r + 0.5) + 50 AS DOUBLE), 6) AS y FROM p"""
)
def pixel_grid(spark, sf_dir):
    """Centres on the ground of the pixels of rasters of several sizes and places."""
    k = c("n_nationkey")
    rasters = table(spark, sf_dir, "nation").select(k.cast("int").alias("id"), (10 + k).alias("h"), (12 + k % 5).alias("w"), F.array(*(F.lit(v) for v in _MAP[:2]), (100.0 + k).cast("double"), *(F.lit(v) for v in _MAP[3:])).alias("transform"))
    return roi.pixel_grids(rasters, ["id"]).select("id", "row", "col", _R("x", 6).alias("x"), _R("y", 6).alias("y"))


@query(
    f"""WITH {POINTS}, g AS (SELECT id % 25 AS area, (-0.25 * (lon - 100) - 0.01 * (lat - 50)) / (0.5 * -0.25 - 0.01 * 0.02) - 0.5 AS x, (0.5 * (lat - 50) - 0.02 * (lon - 100)) / (0.5 * -0.25 - 0.01 * 0.02) - 0.5 AS y FROM pt),
    b AS (SELECT area, floor(min(x)) AS c0, ceil(max(x)) AS c1, floor(min(y)) AS r0, ceil(max(y)) AS r1 FROM g GROUP BY 1),
    v AS (SELECT area, greatest(c0, 0) AS c0, greatest(r0, 0) AS r0, least(c1 + 1, 120) - greatest(c0, 0) AS w, least(r1 + 1, 300) - greatest(r0, 0) AS h FROM b)
    SELECT area, CAST(CASE WHEN w > 0 AND h > 0 THEN c0 ELSE 0 END AS BIGINT) AS col, CAST(CASE WHEN w > 0 AND h > 0 THEN r0 ELSE 0 END AS BIGINT) AS row,
    CAST(CASE WHEN w > 0 AND h > 0 THEN w ELSE 0 END AS BIGINT) AS w, CAST(CASE WHEN w > 0 AND h > 0 THEN h ELSE 0 END AS BIGINT) AS h FROM v"""
)
def geometry_roi(spark, sf_dir):
    """The part of a raster that holds the points of each area."""
    p = points(spark, sf_dir).select((c("id") % 25).alias("area"), c("lon").alias("x"), c("lat").alias("y"))
    return roi.raster_roi(p, ["area"], _MAP, 120, 300).select("area", "roi.*")


@query(
    f"""WITH {POINTS}, b AS (SELECT id % 25 AS area, floor(min(lon * 10)) AS c0, ceil(max(lon * 10)) AS c1, floor(min(lat * 10)) AS r0, ceil(max(lat * 10)) AS r1 FROM pt GROUP BY 1),
    e AS (SELECT area, c0, r0, c1 - c0 + 1 AS w, r1 - r0 + 1 AS h, greatest(c1 - c0 + 1, 1024) AS bw, greatest(r1 - r0 + 1, 512) AS bh FROM b)
    SELECT area, CAST(trunc(c0 + w / 2 - bw / 2) AS BIGINT) AS col, CAST(trunc(r0 + h / 2 - bh / 2) AS BIGINT) AS row, CAST(bw AS BIGINT) AS w, CAST(bh AS BIGINT) AS h FROM e"""
)
def roi_provider(spark, sf_dir):
    """Rectangles around projected areas, of a least size about their centres."""
    p = points(spark, sf_dir).select((c("id") % 25).alias("area"), (c("lon") * 10).alias("x"), (c("lat") * 10).alias("y"))
    return roi.of_geometry(p, ["area"]).select("area", "roi.*")


@query("SELECT vec_id AS id, round(CAST(embedding[4] AS DOUBLE), 6) AS a, round(CAST(embedding[1] AS DOUBLE), 6) AS b, round(CAST(embedding[64] AS DOUBLE), 6) AS c, CAST(NULL AS DOUBLE) AS d FROM embeddings")
def gather_ids(spark, sf_dir):
    """Elements of an array by their places; none beyond its end."""
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), roi.gathered(c("embedding"), F.array(*(F.lit(k) for k in (3, 0, 63, 64)))).alias("v"))
    return e.select("id", *(_R(c("v")[k].cast("double"), 6).alias(n) for k, n in enumerate("abcd")))


@query(
    f"""WITH {DAILY}, w AS (SELECT ps, CASE WHEN day % 5 = 0 THEN NULL ELSE phi END AS phi, 0.05 * day + 0.3 * sin(2 * pi() * (day / 365.25 - 0.25)) AS m, 1 + day % 3 AS w FROM daily)
    SELECT ps, round(sqrt(power(sum(w * cos(phi - m)), 2) + power(sum(w * sin(phi - m)), 2)) / sum(CASE WHEN phi IS NOT NULL THEN w END), 6) AS gamma FROM w GROUP BY ps"""
)
def weighted_coherence(spark, sf_dir):
    """Coherence against a trend and a yearly swing, weighted by date, missing phases left out."""
    d = daily(spark, sf_dir).withColumn("phi", F.when(c("day") % 5 != 0, c("phi")))
    years = c("day") / 365.25
    model = models.compound(models.linear(0.05, c("day"), 1.0), models.seasonal(0.3, years, 1.0, 0.25))
    return d.groupBy("ps").agg(_R(models.coherence(c("phi"), model, (1 + c("day") % 3).cast("double")), 6).alias("gamma"))


@query(
    "SELECT c_custkey AS id, round((0.9 * (c_custkey % 40 + 7) + 0.1 * (c_custkey % 30 / 4.0 + 3) + 2.5) - 5, 6) AS row, round(-0.2 * (c_custkey % 40 + 7) + 1.1 * (c_custkey % 30 / 4.0 + 3) - 1.5 - 6, 6) AS col FROM customer"
)
def matrix_origins(spark, sf_dir):
    """Pixels through an affine map whose images are counted from other origins, the columns of one enlarged four times."""
    m = roi.moved_origins([[0.9, 0.1, 2.5], [-0.2, 1.1, -1.5], [0.0, 0.0, 1.0]], 7, 3, 5, 6)
    m = roi.times(m, roi.zoomed(1, 4))
    k = c("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 40).alias("r"), (k % 30).alias("q"))
    return p.select("id", *(_R(m[i][0] * c("r") + m[i][1] * c("q") + m[i][2], 6).alias(n) for i, n in enumerate(("row", "col"))))


@query(
    f"WITH {POINTS} SELECT id, round(3 + 0.5 * lon - 0.25 * lat + 0.01 * lon * lat + 0.002 * lat * lat, 5) AS fit FROM pt"
)
def surface_fit(spark, sf_dir):
    """A quadratic surface recovered from its points, group by group."""
    p = points(spark, sf_dir).select("id", (c("id") % 3).alias("g"), c("lon").alias("x"), c("lat").alias("y"))
    p = p.withColumn("z", 3 + 0.5 * c("x") - 0.25 * c("y") + 0.01 * c("x") * c("y") + 0.002 * c("y") * c("y"))
    return fits.evaluated(p, fits.surfaces(p, 2, ["g"]), 2, ["g"]).select("id", _R("fit", 5).alias("fit"))


@query("SELECT s_suppkey AS id, round(CAST(0.5 + s_suppkey % 60 AS DOUBLE), 4) AS t FROM supplier")
def node_crossing(spark, sf_dir):
    """When orbits rise through the equator: a circle each, of state vectors every ten seconds, some minutes apart."""
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("key"), F.explode(F.array(*(F.lit(float(t)) for t in range(-80, 81, 10)))).alias("t"))
    u = _RATE * (c("t") - 0.5 - c("key") % 60)
    tilted = (("x", F.cos(u), -F.sin(u)), ("y", F.sin(u) * float(np.cos(_TILT)), F.cos(u) * float(np.cos(_TILT))), ("z", F.sin(u) * float(np.sin(_TILT)), F.cos(u) * float(np.sin(_TILT))))
    states = s.select("key", "t", *((_A * p).alias(n) for n, p, _ in tilted), *((_A * _RATE * v).alias(f"v{n}") for n, _, v in tilted))
    return geometry.node_crossings(states).select(c("key").alias("id"), _R("t", 4).alias("t"))


@query("SELECT vec_id AS id, (i - 1) // 8 AS row, (i - 1) % 8 AS col, round(CAST(embedding[i] AS DOUBLE), 5) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def fourier_zoom_samples(spark, sf_dir):
    """An image enlarged three times in the Fourier domain has its own pixels at every third place."""
    wide = kernels.on_images(small_images(spark, sf_dir), (8, 8), lambda x: [kernels.zoomed(x, 3)[::3, ::3].ravel()], "v array<double>")
    return wide.select("id", F.posexplode("v").alias("k", "v")).select("id", F.expr("k div 8").cast("long").alias("row"), (c("k") % 8).cast("long").alias("col"), _R("v", 5).alias("v"))


@query("SELECT vec_id AS id, (i - 1) // 8 AS row, (i - 1) % 8 AS col, round(CAST((vec_id % 7 - 3) * 0.9 * ((i - 1) // 8) + (vec_id % 5 - 2) * 1.4 * ((i - 1) % 8) AS DOUBLE), 6) AS u FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def unwrap_ramp(spark, sf_dir):
    """Ramps of phase, wrapped and unwrapped, up to their first pixel."""

    def unwrap(x):
        slopes = x.ravel()[:2]
        ramp = slopes[0] * np.arange(8)[:, None] + slopes[1] * np.arange(8)[None, :]
        u = kernels.unwrapped(kernels.wrapped(ramp))[0]
        return [(u - u[0, 0]).ravel()]

    k = c("vec_id")
    ramps = table(spark, sf_dir, "embeddings").select(k.alias("id"), F.array(((k % 7 - 3) * 0.9).cast("double"), ((k % 5 - 2) * 1.4).cast("double")).alias("pixels"))
    done = kernels.on_images(ramps, (1, 2), unwrap, "u array<double>")
    return done.select("id", F.posexplode("u").alias("k", "u")).select("id", F.expr("k div 8").cast("long").alias("row"), (c("k") % 8).cast("long").alias("col"), _R("u", 6).alias("u"))


# height models: a plane in longitude and latitude on two grids, so that what is interpolated in it is known

_FINE, _COARSE = dem.Grid(-180.0, 90.0, 2.0), dem.Grid(-180.0, 90.0, 15.0)


def _nodes(spark, grid: dem.Grid, value: Column, name: str):
    rows, cols = int(180 / grid.step) + 1, int(360 / grid.step) + 1
    at = roi.pixel_grid(spark, rows, cols).select("row", "col", (grid.west + c("col") * grid.step).alias("lon"), (grid.north - c("row") * grid.step).alias("lat"))
    return at.select("row", "col", value.alias(name))


@query(f"WITH {POINTS} SELECT id, round(100 + 2 * lon - 3 * lat + 20 + 0.1 * lon + 0.2 * lat, 4) AS alt FROM pt WHERE lon BETWEEN -100 AND 120 AND lat BETWEEN -50 AND 60")
def dem_elevation(spark, sf_dir):
    """Heights over the ellipsoid at points: two sources stitched, fetched by bounds, the geoid added."""
    plane = 100 + 2 * c("lon") - 3 * c("lat")
    first = _nodes(spark, _FINE, F.when(c("col") % 3 != 0, plane), "alt")
    second = _nodes(spark, _FINE, plane, "alt")
    geoid = _nodes(spark, _COARSE, 20 + 0.1 * c("lon") + 0.2 * c("lat"), "undulation")
    nodes = dem.fetched(dem.stitched([first, second]), _FINE, -100, -50, 120, 60)
    high = dem.ellipsoidal(nodes, _FINE, geoid, _COARSE)
    p = points(spark, sf_dir).where("lon between -100 and 120 and lat between -50 and 60").select("id", "lon", "lat")
    return dem.sampled(high, _FINE, p).select("id", _R("alt", 4).alias("alt"))


def _hills(spark):
    return _nodes(spark, _FINE, 400 + 2 * c("lon") + 3 * c("lat"), "alt")


@query("SELECT c_custkey AS id, true AS on_surface, true AS on_range FROM customer")
def localize_on_table(spark, sf_dir):
    """Image points on a table of heights: they lie on the surface, and back at their times and ranges."""
    k = c("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1200 / 10.0 - 60).alias("azt"), (800000.0 + k * 53 % 1500 * 100).alias("rng"))
    found = dem.localized(p, circular_orbit(), _hills(spark), _FINE)
    back = geometry.project(found.select(F.struct("id", "azt", "rng", "lon", "lat", "alt").alias("id"), "x", "y", "z"), circular_orbit())
    flat = back.select("id.*", c("azt").alias("azt_back"), c("rng").alias("rng_back"))
    off = F.abs(400 + 2 * c("lon") + 3 * c("lat") - c("alt"))
    return flat.select("id", (off < 0.01).alias("on_surface"), ((F.abs(c("azt_back") - c("azt")) < 1e-6) & (F.abs(c("rng_back") - c("rng")) < 0.01)).alias("on_range"))


@query("SELECT n_nationkey AS area, CAST(k AS INTEGER) AS k, true AS on_surface FROM nation, (SELECT unnest(range(100)) AS k)")
def control_points(spark, sf_dir):
    """Grids of ground control points, one an area, on a table of heights."""
    n = c("n_nationkey")
    areas = table(spark, sf_dir, "nation").select(n.alias("id"), (n - 40.0).alias("azt0"), (n + 20.0).alias("azt1"), (820_000.0 + n * 500).alias("rng0"), (870_000.0 + n * 800).alias("rng1"))
    g = dem.control_points(areas, circular_orbit(), _hills(spark), _FINE)
    return g.select(c("id.id").alias("area"), "id.k", (F.abs(400 + 2 * c("lon") + 3 * c("lat") - c("alt")) < 0.01).alias("on_surface"))


_ITEMS = """item AS (SELECT o_orderkey AS id, 'S1_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS name, CASE o_orderkey % 3 WHEN 0 THEN 'SLC' WHEN 1 THEN 'GRD' ELSE 'COG' END AS product_type, epoch(o_orderdate) AS start, epoch(o_orderdate) + 27 AS stop,
  o_custkey % 175 + 1 AS relative_orbit, CASE WHEN o_orderstatus = 'F' THEN 'VV&VH' ELSE 'HH' END AS polarisation, o_orderstatus <> 'P' AS online FROM orders)"""


def _items(spark, sf_dir):
    k, t = c("o_orderkey"), F.unix_micros(c("o_orderdate").cast("timestamp")) / 1e6
    kind = F.when(k % 3 == 0, "SLC").when(k % 3 == 1, "GRD").otherwise("COG")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("S1_"), F.lpad(k.cast("string"), 8, "0")).alias("name"), kind.alias("product_type"), t.alias("start"), (t + 27).alias("stop"), (c("o_custkey") % 175 + 1).alias("relative_orbit"),
        F.when(c("o_orderstatus") == "F", "VV&VH").otherwise("HH").alias("polarisation"), (c("o_orderstatus") != "P").alias("online"),
    )


def _scan(kind: str) -> str:
    return f"""WITH {_ITEMS} SELECT id, name FROM item WHERE start > epoch(TIMESTAMP '1995-01-01') AND start < epoch(TIMESTAMP '1996-06-01') AND stop < epoch(TIMESTAMP '1996-06-01') AND online AND product_type = '{kind}'
      AND polarisation IN ('VV&VH') ORDER BY start, name LIMIT 500"""


def _scanned(spark, sf_dir, kind: str):
    lo, hi = 788918400.0, 833587200.0
    return catalog.search(_items(spark, sf_dir), lo, hi, product_type=kind, polarisations=["VV&VH"], limit=500).select("id", "name")


@query(_scan("SLC"))
def catalog_scan_slc(spark, sf_dir):
    return _scanned(spark, sf_dir, "SLC")


@query(_scan("GRD"))
def catalog_scan_grd(spark, sf_dir):
    return _scanned(spark, sf_dir, "GRD")


@query(f"WITH {_ITEMS} SELECT id, name FROM item WHERE relative_orbit = 44 AND online AND start > 0 ORDER BY start, name LIMIT 1000")
def catalog_scan_orbit(spark, sf_dir):
    return catalog.search(_items(spark, sf_dir), 0.0, 4e9, relative_orbit=44).select("id", "name")


@query(f"WITH {_ITEMS} SELECT id, name, relative_orbit FROM item WHERE name = 'S1_00000007'")
def catalog_lookup(spark, sf_dir):
    return catalog.lookup(_items(spark, sf_dir), "S1_00000007").select("id", "name", "relative_orbit")


# parsers: texts written from the rows of a table and read back


def _text(template: str, **parts: Column) -> Column:
    """A text with the columns' values in place of {names}."""
    bits = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(b) if k % 2 == 0 else parts[b].cast("string") for k, b in enumerate(bits) if b))


_STAMP = "2021-01-01T00:{m}:{s}.500000"


def _parts(spark, sf_dir, template: str):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = _text(template, k=c("p_partkey"), n=c("p_size"), m=two(c("p_partkey") % 60), s=two(c("p_size") % 60), price=c("p_retailprice"), orbit=c("p_partkey") % 50 + 100)
    # rows are dealt to tasks before they become long texts: a table of short rows is one piece of a file
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition("p_partkey")
    return rows.select(c("p_partkey").cast("string").alias("path"), text.alias("text"))


_HEADER = "<adsHeader><missionId>S1A</missionId><absoluteOrbitNumber>{orbit}</absoluteOrbitNumber><swath>IW2</swath></adsHeader>"
_GENERAL = (
    "<generalAnnotation><productInformation><pass>Descending</pass><rangeSamplingRate>6.4e+07</rangeSamplingRate><radarFrequency>5.405e+09</radarFrequency><azimuthSteeringRate>1.5</azimuthSteeringRate></productInformation>"
    f"<orbitList count=\"1\"><orbit><time>{_STAMP}</time><position><x>{{price}}</x><y>2</y><z>3</z></position><velocity><x>4</x><y>5</y><z>{{n}}</z></velocity></orbit></orbitList></generalAnnotation>"
)
_IMAGE = (
    f"<imageAnnotation><imageInformation><azimuthFrequency>4</azimuthFrequency><slantRangeTime>0.0053</slantRangeTime><ascendingNodeTime>{_STAMP}</ascendingNodeTime><sliceNumber>{{n}}</sliceNumber><sliceList count=\"60\"/>"
    f"<productFirstLineUtcTime>{_STAMP}</productFirstLineUtcTime><productLastLineUtcTime>{_STAMP}</productLastLineUtcTime><azimuthTimeInterval>0.0015</azimuthTimeInterval><rangePixelSpacing>10</rangePixelSpacing>"
    "<numberOfSamples>{k}</numberOfSamples><numberOfLines>{n}</numberOfLines></imageInformation><processingInformation><dcMethod>Data Analysis</dcMethod></processingInformation></imageAnnotation>"
)
_SECONDS = "CAST(1609459200.5 + 60 * (p_partkey % 60) + p_size % 60 AS DOUBLE)"


@query(
    f"""WITH b AS (SELECT unnest([0, 1]) AS burst) SELECT p_partkey AS id, burst, (p_partkey % 50 + 100 - 73 + 175) % 175 + 1 AS relative_orbit, p_size AS slice_number, 60 AS slice_count, {_SECONDS} AS anx_time, round(p_retailprice, 2) AS x, CAST(p_size AS DOUBLE) AS vz,
    {_SECONDS} + burst AS start, {_SECONDS} + burst + 0.25 AS start_valid, 7 AS col, 1 + burst * 5 AS row, 84 AS w, 3 AS h FROM part, b"""
)
def slc_annotation(spark, sf_dir):
    """Bursts of annotation texts."""
    burst = "<burst><azimuthTime>{t}</azimuthTime><azimuthAnxTime>1</azimuthAnxTime><sensingTime>{t}</sensingTime><firstValidSample count=\"5\">-1 7 7 7 -1</firstValidSample><lastValidSample count=\"5\">-1 90 90 90 -1</lastValidSample></burst>"
    timing = "<swathTiming><linesPerBurst>5</linesPerBurst><samplesPerBurst>100</samplesPerBurst><burstList count=\"2\">" + burst.replace("{t}", _STAMP) + burst.replace("{t}", "2021-01-01T00:{m}:{s}.500000") + "</burstList></swathTiming>"
    texts = _parts(spark, sf_dir, "<product>" + _HEADER + _GENERAL + _IMAGE + timing + "</product>")
    b = metadata.slc_bursts(texts)
    # the second burst's text has the first one's time; its place tells them apart
    return b.select(
        c("path").cast("long").alias("id"), "burst", c("relative_orbit_number").cast("long").alias("relative_orbit"), "slice_number", "slice_count", "anx_time", _R(c("state_vectors")[0]["position"]["x"], 2).alias("x"), c("state_vectors")[0]["velocity"]["z"].alias("vz"),
        (c("burst_times.start") + c("burst")).alias("start"), (c("burst_times.start_valid") + c("burst")).alias("start_valid"), "burst_roi.col", "burst_roi.row", "burst_roi.w", "burst_roi.h",
    )


@query(f"SELECT p_partkey AS id, p_partkey AS width, p_size AS height, {_SECONDS} AS image_start, {_SECONDS} AS time, round(p_retailprice, 2) AS sr0, CAST(1 AS DOUBLE) AS c0, CAST(p_size AS DOUBLE) AS c1 FROM part")
def grd_annotation(spark, sf_dir):
    """Ground-range products of annotation texts."""
    conversion = f"<coordinateConversion><coordinateConversionList><coordinateConversion><azimuthTime>{_STAMP}</azimuthTime><sr0>{{price}}</sr0><srgrCoefficients count=\"2\">1 {{n}}</srgrCoefficients><gr0>0</gr0><grsrCoefficients count=\"2\">3 4</grsrCoefficients></coordinateConversion></coordinateConversionList></coordinateConversion>"
    g = metadata.grd_products(_parts(spark, sf_dir, "<product>" + _HEADER + _GENERAL + _IMAGE + conversion + "</product>")).withColumn("s", c("srgr")[0])
    return g.select(c("path").cast("long").alias("id"), c("width").cast("long").alias("width"), "height", "image_start", "s.time", _R("s.sr0", 2).alias("sr0"), c("s.srgr")[0].alias("c0"), c("s.srgr")[1].alias("c1"))


@query("SELECT p_partkey AS id, './annotation/s1a-iw' || p_size || '-vv.xml' AS href FROM part")
def manifest_link(spark, sf_dir):
    """The annotation that a manifest lists first."""
    link = "<dataObject><byteStream><fileLocation locatorType=\"URL\" href=\"{}\"/></byteStream></dataObject>"
    names = ["./measurement/s1a-iw{n}-vv.tiff", "./annotation/s1a-iw{n}-vv.xml", "./annotation/s1a-iw{k}-vv.xml"]
    texts = _parts(spark, sf_dir, "<XFDU><dataObjectSection>" + "".join(link.replace("{}", x) for x in names) + "</dataObjectSection></XFDU>")
    found = metadata.first_link(metadata.manifest_links(texts), "annotation/.*vv")
    return found.select(c("path").cast("long").alias("id"), "href")


@query("SELECT p_partkey AS id, p_size AS line, i * 40 AS pixel, round(CASE i WHEN 0 THEN p_retailprice ELSE p_size + i END, 2) AS value FROM part, (SELECT unnest(range(3)) AS i)")
def calibration_nodes(spark, sf_dir):
    """Lookup tables of calibration texts."""
    xml = "<calibration><calibrationVectorList count=\"1\"><calibrationVector><line>{n}</line><pixel count=\"3\">0 40 80</pixel><sigmaNought count=\"3\">{price} {one} {two}</sigmaNought></calibrationVector></calibrationVectorList></calibration>"
    text = _text(xml, n=c("p_size"), price=c("p_retailprice"), one=c("p_size") + 1, two=c("p_size") + 2)
    found = metadata.calibration_lut(table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("path"), text.alias("text")))
    return found.select(c("path").cast("long").alias("id"), "line", c("pixel").cast("long").alias("pixel"), _R("value", 2).alias("value"))


@query("SELECT p_partkey AS id, p_partkey % 100 AS pixel, CAST(p_size AS DOUBLE) AS value, p_size AS line0, p_size + 7 AS line1, CAST(0.5 AS DOUBLE) AS last FROM part")
def noise_nodes(spark, sf_dir):
    """Range vectors and azimuth rectangles of noise texts, of the older form for every other product."""
    new = "<noise><noiseRangeVectorList><noiseRangeVector><line>0</line><pixel count=\"1\">{p}</pixel><noiseRangeLut count=\"1\">{n}</noiseRangeLut></noiseRangeVector></noiseRangeVectorList>"
    old = "<noise><noiseVectorList><noiseVector><line>0</line><pixel count=\"1\">{p}</pixel><noiseLut count=\"1\">{n}</noiseLut></noiseVector></noiseVectorList>"
    block = "<noiseAzimuthVectorList count=\"1\"><noiseAzimuthVector><firstAzimuthLine>{n}</firstAzimuthLine><firstRangeSample>1</firstRangeSample><lastAzimuthLine>{e}</lastAzimuthLine><lastRangeSample>9</lastRangeSample><line count=\"2\">0 7</line><noiseAzimuthLut count=\"2\">1 0.5</noiseAzimuthLut></noiseAzimuthVector></noiseAzimuthVectorList></noise>"
    made = lambda head: _text(head + block, p=c("p_partkey") % 100, n=c("p_size"), e=c("p_size") + 7)
    texts = table(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("path"), F.when(c("p_partkey") % 2 == 0, made(new)).otherwise(made(old)).alias("text"))
    blocks = metadata.noise_azimuth_blocks(texts).select("path", "line0", "line1", c("values")[1].alias("last"))
    return metadata.noise_lut(texts).join(blocks, "path").select(c("path").cast("long").alias("id"), c("pixel").cast("long").alias("pixel"), "value", "line0", "line1", "last")


@query("SELECT p_partkey AS id, p_size AS height, p_partkey AS width, round(p_retailprice, 2) AS incidence, CAST(1609459200 AS BIGINT) * 1000000000 + CAST(p_size % 60 AS BIGINT) * 1000000000 + 123456789 AS start_ns, CAST(p_size % 60 + 0.25 AS DOUBLE) AS first_line_time, 'left' AS look_direction FROM part")
def capella_parse(spark, sf_dir):
    """Extended metadata in JSON."""
    text = (
        '<"product_type": "SLC", "collect": <"start_timestamp": "2021-01-01T00:00:{s}.123456789Z", "stop_timestamp": "2021-01-01T00:01:00Z", "radar": <"center_frequency": 9.65e9, "transmit_polarization": "H", "receive_polarization": "H", "pointing": "left">,'
        ' "state": <"direction": "ascending", "source": "precise", "state_vectors": []>, "image": <"rows": {n}, "columns": {k}, "scale_factor": 1.5, "center_pixel": <"incidence_angle": {price}, "target_position": [1, 2, 3]>,'
        ' "image_geometry": <"type": "slant_plane", "range_to_first_sample": 1.0, "delta_range_sample": 0.5, "delta_line_time": 0.001, "first_line_time": "2021-01-01T00:00:{s}.25Z">>>>'
    )
    t = _parts(spark, sf_dir, text).withColumn("text", F.translate("text", "<>", "{}"))
    m = metadata.capella(t)
    return m.select(c("path").cast("long").alias("id"), "height", c("width").cast("long").alias("width"), _R("incidence", 2).alias("incidence"), "start_ns", _R("first_line_time", 6).alias("first_line_time"), "look_direction")


@query(f"SELECT p_partkey AS id, p_size AS height, p_partkey AS width, {_SECONDS} AS image_start, round(p_retailprice, 2) AS x, 'ascending' AS orbit_direction FROM part")
def terrasar_parse(spark, sf_dir):
    """Products of another sensor."""
    xml = (
        "<level1Product><generalHeader><mission>TSX-1</mission></generalHeader><productInfo><imageDataInfo><imageRaster><numberOfRows>{n}</numberOfRows><numberOfColumns>{k}</numberOfColumns><columnSpacing units=\"s\">0.5</columnSpacing><rowSpacing units=\"s\">0.25</rowSpacing></imageRaster></imageDataInfo>"
        f"<sceneInfo><start><timeUTC>{_STAMP}Z</timeUTC></start><rangeTime><firstPixel>0.004</firstPixel></rangeTime></sceneInfo><missionInfo><orbitDirection>ASCENDING</orbitDirection></missionInfo><acquisitionInfo><lookDirection>RIGHT</lookDirection></acquisitionInfo></productInfo>"
        "<instrument><radarParameters><centerFrequency>9.65e9</centerFrequency></radarParameters></instrument>"
        f"<platform><orbit><stateVec num=\"1\"><timeUTC>{_STAMP}</timeUTC><posX>{{price}}</posX><posY>2</posY><posZ>3</posZ><velX>4</velX><velY>5</velY><velZ>6</velZ></stateVec></orbit></platform></level1Product>"
    )
    m = metadata.terrasar(_parts(spark, sf_dir, xml))
    return m.select(c("path").cast("long").alias("id"), "height", c("width").cast("long").alias("width"), "image_start", _R(c("state_vectors")[0]["position"]["x"], 2).alias("x"), "orbit_direction")
