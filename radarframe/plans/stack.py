"""Queries on bursts, corrections, maps to the ground, stored slices and interferograms of a stack."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import bursts, correction, kernels, ortho, predict, spline
from radarframe.plans.catalogue import query, table
from radarframe.plans.dense import circular_orbit
from radarframe.plans.pixels import PAIR, POINTS, RASTER, pairs, pixels, points, sql_wrap
from radarframe.plans.series import _written
from radarframe.sources import store, tiff

c = F.col
_R = F.round
_ORBIT = bursts.T_ORBIT
_STEP = 360 / phase.CYCLE_ORBITS * 12


@query(
    f"""WITH {POINTS}, b AS (SELECT id, lon, 1 + id % 175 AS rel, {_ORBIT - 80} + id % 160 AS anx, {_ORBIT - 20} + id % 40 AS first_anx FROM pt),
    e AS (SELECT *, 4.5 - {_STEP} * (rel - 1) + 180 AS u FROM b), x AS (SELECT *, u - 360 * floor(u / 360) - 180 AS expected FROM e)
    SELECT id, round(CASE WHEN NOT (abs(anx - {_ORBIT}) < 50 AND abs(lon - expected) > {_STEP / 2}) AND first_anx > {_ORBIT} THEN -{_ORBIT} ELSE 0 END, 6) AS correction FROM x"""
)
def burst_node_correction(spark, sf_dir):
    """Bursts around an ascending node, with the orbit taken off their time."""
    i = c("id")
    found = bursts.node_correction((_ORBIT - 80) + i % 160, (_ORBIT - 20) + i % 40, c("lon"), 1 + i % 175)
    return points(spark, sf_dir).select("id", _R(found, 6).alias("correction"))


_FREQUENCY = 486.0
_BURSTS = """b AS (SELECT p_partkey // 27 AS acquisition, 'iw' || (1 + p_partkey % 27 // 9) AS swath, p_partkey % 9 AS burst, CAST(p_partkey % 27 // 9 * 20000 + p_partkey % 5 AS INT) AS col,
  CAST(p_partkey % 9 * 1340 AS INT) AS row, CAST(20500 + p_partkey % 7 AS INT) AS w, CAST(1480 + p_partkey % 3 AS INT) AS h, p_partkey % 9 * 1340 / 486.0 AS s, (p_partkey % 9 * 1340 + 1480 + p_partkey % 3) / 486.0 AS e FROM part),
  k AS (SELECT *, min(CASE WHEN swath = 'iw1' THEN col + w END) OVER a AS r1, max(CASE WHEN swath = 'iw2' THEN col END) OVER a AS l2, min(CASE WHEN swath = 'iw2' THEN col + w END) OVER a AS r2, max(CASE WHEN swath = 'iw3' THEN col END) OVER a AS l3,
    min(col) OVER g AS lo, max(col + w) OVER g AS hi, CAST(coalesce(round((e - lead(s) OVER (g ORDER BY burst)) * 486.0), 0) AS BIGINT) AS o FROM b WINDOW a AS (PARTITION BY acquisition), g AS (PARTITION BY acquisition, swath)),
  m AS (SELECT *, coalesce((r1 + l2) // 2, r1, l2) AS c12, coalesce((r2 + l3) // 2, r2, l3) AS c23, coalesce(lag(o) OVER (PARTITION BY acquisition, swath ORDER BY burst), 0) AS p FROM k),
  n AS (SELECT *, greatest(0, CASE swath WHEN 'iw1' THEN lo WHEN 'iw2' THEN c12 ELSE c23 END - col) AS x0, least(w, CASE swath WHEN 'iw1' THEN c12 WHEN 'iw2' THEN c23 ELSE hi END - col) AS x1 FROM m),
  cuts AS (SELECT acquisition, swath, burst, col, row, x0, p // 2 AS y0, x1 - x0 AS iw, h - p // 2 - (o - o // 2) AS ih FROM n)"""


def _bursts(spark, sf_dir):
    k = c("p_partkey")
    i = F.floor(k % 27 / 9)
    df = table(spark, sf_dir, "part").select(
        F.floor(k / 27).alias("acquisition"), F.concat(F.lit("iw"), (1 + i).cast("string")).alias("swath"), (k % 9).alias("burst"), (i * 20000 + k % 5).cast("int").alias("col"),
        (k % 9 * 1340).cast("int").alias("row"), (20500 + k % 7).cast("int").alias("w"), (1480 + k % 3).cast("int").alias("h"), (k % 9 * 1340 / _FREQUENCY).alias("start"), ((k % 9 * 1340 + 1480 + k % 3) / _FREQUENCY).alias("end"),
    )
    return bursts.cut(df, _FREQUENCY)


@query(f"WITH {_BURSTS} SELECT acquisition, swath, burst, x0, y0, iw, ih FROM cuts")
def burst_cuts(spark, sf_dir):
    """Inner rectangles of the bursts of each acquisition."""
    return _bursts(spark, sf_dir).select("acquisition", "swath", "burst", c("inner.col").alias("x0"), c("inner.row").cast("long").alias("y0"), c("inner.w").alias("iw"), c("inner.h").cast("long").alias("ih"))


@query(
    f"""WITH {_BURSTS}, q AS (SELECT *, greatest(col + x0, 15000) AS a, greatest(row + y0, 2000) AS t, least(col + x0 + iw, 45000) AS z, least(row + y0 + ih, 9000) AS f FROM cuts)
    SELECT acquisition, swath, burst, a - col AS read_col, t - row AS read_row, a - 15000 AS write_col, t - 2000 AS write_row, z - a AS w, f - t AS h FROM q WHERE z > a AND f > t"""
)
def deburst_rectangles(spark, sf_dir):
    """What to read from each burst, and where to write it, for one rectangle of the mosaic."""
    s = bursts.stitched(_bursts(spark, sf_dir), (15000, 2000, 30000, 7000))
    return s.select("acquisition", "swath", "burst", *(c(f"{k}.{v}").cast("long" if v == "row" else "int").alias(f"{k}_{v}") for k in ("read", "write") for v in ("col", "row")), c("read.w").alias("w"), c("read.h").cast("long").alias("h"))


@query(
    f"""WITH {_BURSTS}, q AS (SELECT row_number() OVER () AS n, l_orderkey * 8 + l_linenumber AS id, l_partkey // 27 AS acquisition, l_orderkey * 131 % 61000 AS x, l_suppkey * 977 % 12500 AS y FROM lineitem),
    hit AS (SELECT q.n, cuts.swath, cuts.burst FROM q JOIN cuts ON q.acquisition = cuts.acquisition AND x >= col + x0 AND x < col + x0 + iw AND y >= row + y0 AND y < row + y0 + ih)
    SELECT id, first(swath ORDER BY swath, burst) AS swath, first(burst ORDER BY swath, burst) AS burst FROM q LEFT JOIN hit USING (n) GROUP BY n, id"""
)
def burst_of_point(spark, sf_dir):
    """The one burst whose inner rectangle holds a place of the mosaic, if any."""
    q = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), F.floor(c("l_partkey") / 27).alias("acquisition"), (c("l_orderkey") * 131 % 61000).alias("x"), (c("l_suppkey") * 977 % 12500).alias("y"))
    return bursts.assigned(q, _bursts(spark, sf_dir)).select("id", "swath", "burst")


_C = phase.LIGHT_SPEED


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_custkey * 0.002 AS azt, 8e5 + c_custkey % 900 * 2.3 AS rng, c_acctbal AS alt, 0.5 + c_nationkey % 25 * 0.01 AS inc FROM customer)
    SELECT id, round(azt + 0.25 / 486 + (rng - 8e5) / {_C} * 2, 9) AS azt, round(rng + 1.5 / 64e6 * {_C} / 2 + (alt * alt / 8.55e7 - alt / 3411 + 2.41) / cos(inc), 6) AS rng FROM p"""
)
def corrector_chain(spark, sf_dir):
    """Three corrections, all estimated on the uncorrected points, added in one projection."""
    k = c("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 0.002).alias("azt"), (8e5 + k % 900 * 2.3).alias("rng"), c("c_acctbal").alias("alt"), (0.5 + c("c_nationkey") % 25 * 0.01).alias("inc"))
    chain = [correction.pixels(1.5, 0.25, 486.0, 64e6), lambda: {"azt": (c("rng") - 8e5) / _C * 2}, lambda: {"rng": phase.path_delay(c("alt"), c("inc"))}]
    return correction.corrected(p, chain).select("id", _R("azt", 9).alias("azt"), _R("rng", 6).alias("rng"))


def _utm_sql() -> str:
    radius, alpha = phase._krueger()
    e = math.sqrt(phase.WGS84_E2)
    terms = lambda f, g: " + ".join(f"({a!r}) * {f}({2 * (k + 1)} * xi) * {g}({2 * (k + 1)} * eta)" for k, a in enumerate(alpha))
    return f"""WITH {POINTS}, z AS (SELECT id, lon, lat * 0.84 / 0.9 AS lat, CAST(floor((lon + 180) / 6) + 1 AS BIGINT) AS zone FROM pt),
    t AS (SELECT *, radians(lat) AS f, radians(lon - (zone * 6 - 183)) AS l FROM z), u AS (SELECT *, sinh(atanh(sin(f)) - {e!r} * atanh({e!r} * sin(f))) AS t FROM t),
    x AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM u)
    SELECT id, zone, round(5e5 + {phase.UTM_SCALE * radius!r} * (eta + {terms('cos', 'sinh')}), 3) AS east, round({phase.UTM_SCALE * radius!r} * (xi + {terms('sin', 'cosh')}) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 3) AS north FROM x"""


@query(_utm_sql())
def utm_forward(spark, sf_dir):
    """Points in their own zone's frame."""
    p = points(spark, sf_dir).select("id", "lon", (c("lat") * 0.84 / 0.9).alias("lat"), (F.floor((c("lon") + 180) / 6) + 1).alias("zone"))
    east, north = phase.utm(c("lon"), c("lat"), c("zone"))
    return p.select("id", "zone", _R(east, 3).alias("east"), _R(north, 3).alias("north"))


_MAP = """g AS (SELECT c_custkey AS id, (c_custkey * 37 % 9900) / 100.0 AS y, (c_custkey * 53 % 6400) / 100.0 - 0.25 AS x FROM customer)"""


@query(
    f"""WITH {RASTER}, {_MAP}, k AS (SELECT id, floor(y) + i AS row, floor(x) + j AS col, (CASE i WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE j WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT id, round(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 1 - 1e-9 THEN sum(w * v) END, 6) AS v FROM k LEFT JOIN raster USING (row, col) WHERE w > 0 GROUP BY id"""
)
def ortho_pull(spark, sf_dir):
    """A raster pulled through a map of image places; null where a corner that counts is missing."""
    k = c("c_custkey")
    g = table(spark, sf_dir, "customer").select(k.alias("row"), F.lit(0).alias("col"), (k * 37 % 9900 / 100.0).alias("y"), (k * 53 % 6400 / 100.0 - 0.25).alias("x"))
    return ortho.pulled(pixels(spark, sf_dir), g, ["v"]).select(c("row").alias("id"), _R("v", 6).alias("v"))


@query(
    f"""WITH {RASTER}, {_MAP} SELECT id, round(v, 6) AS v FROM g LEFT JOIN raster ON row = CAST(round_even(y * 0.5 - 3, 0) AS BIGINT) AND col = CAST(round_even(x * 0.5 + 2, 0) AS BIGINT)"""
)
def ortho_nearest(spark, sf_dir):
    """The nearest pixel of a raster under a map of image places."""
    k = c("c_custkey")
    g = table(spark, sf_dir, "customer").select(k.alias("row"), F.lit(0).alias("col"), (k * 37 % 9900 / 100.0 * 0.5 - 3).alias("y"), ((k * 53 % 6400 / 100.0 - 0.25) * 0.5 + 2).alias("x"))
    return ortho.pulled(pixels(spark, sf_dir), g, ["v"], nearest=True).select(c("row").alias("id"), _R("v", 6).alias("v"))


@query(
    """WITH have AS (SELECT DISTINCT l_suppkey % 175 AS orbit, l_linenumber AS slice_id FROM lineitem WHERE l_returnflag = 'R'), want AS (SELECT DISTINCT o_custkey % 175 AS orbit, 1 + o_orderkey % 9 AS slice_id FROM orders)
    SELECT orbit, slice_id, 'orbit-' || lpad(CAST(orbit AS VARCHAR), 3, '0') || '_slice_id-' || slice_id || '_millisecs-1000_rowmargin-8_nearcolmargin-16_farcolmargin-16' AS name
    FROM want WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.orbit = want.orbit AND have.slice_id = want.slice_id)"""
)
def slices_to_make(spark, sf_dir):
    """Slices wanted that aren't stored yet, with the names they will have."""
    have = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((c("l_suppkey") % 175).alias("orbit"), c("l_linenumber").cast("long").alias("slice_id"))
    want = table(spark, sf_dir, "orders").select((c("o_custkey") % 175).alias("orbit"), (1 + c("o_orderkey") % 9).alias("slice_id"))
    return store.missing(want, have, ["orbit", "slice_id"]).select("orbit", "slice_id", store.slice_name(c("orbit"), c("slice_id"), 1000, 8, 16, 16).alias("name"))


@query("""SELECT s_suppkey AS id, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS key FROM supplier""")
def cache_key(spark, sf_dir):
    """Digests of canonical JSON."""
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), store.key("s_suppkey", "s_name", "s_nationkey", bits=256).alias("key"))


@query(f"WITH {RASTER} SELECT row, col, round(v, 6) AS v FROM raster")
def geotiff_round_trip(spark, sf_dir):
    """A raster written to GeoTIFF tiles and read back."""
    back = tiff.pixels(tiff.files(pixels(spark, sf_dir), "v", size=128), ["tile_row", "tile_col"])
    return back.select((c("tile_row") * 128 + c("row")).alias("row"), (c("tile_col") * 128 + c("col")).alias("col"), _R("value", 6).alias("v"))


_SIMULATED = "sim AS (SELECT p_partkey % 32 AS col, avg(p_retailprice) / 300 AS flat FROM part WHERE p_partkey % 32 < 24 GROUP BY 1)"


@query(
    f"""WITH {PAIR}, {_SIMULATED}, z AS (SELECT row // 2 AS r, col // 8 AS k, r1 * r2 + i1 * i2 AS re, i1 * r2 - r1 * i2 AS im, r1 * r1 + i1 * i1 AS p1, r2 * r2 + i2 * i2 AS p2, coalesce(flat, 0) - 0.05 * row AS f FROM pair LEFT JOIN sim USING (col)),
    t AS (SELECT r, k, avg(re * cos(f) - im * sin(f)) AS re, avg(re * sin(f) + im * cos(f)) AS im, avg(p1) AS p1, avg(p2) AS p2 FROM z GROUP BY 1, 2)
    SELECT r AS row, k AS col, round({sql_wrap('atan2(im, re)')}, 5) AS phi, round(sqrt(re * re + im * im) / (sqrt(p1 * p2) + 1e-10), 6) AS coherence FROM t"""
)
def interferogram_stack(spark, sf_dir):
    """Formed, flattened with what simulations there are, corrected for topography, multilooked 2 x 8, with its coherence."""
    sim = table(spark, sf_dir, "part").where("p_partkey % 32 < 24").groupBy((c("p_partkey") % 32).alias("col")).agg((F.avg("p_retailprice") / 300).alias("flat"))
    both = pairs(spark, sf_dir).join(sim, "col", "left")
    z = phase.times_conj(phase.complex_of(c("r1"), c("i1")), phase.complex_of(c("r2"), c("i2")))
    f = F.coalesce(c("flat"), F.lit(0.0)) - 0.05 * c("row")
    turned = both.select(F.floor(c("row") / 2).alias("row"), F.floor(c("col") / 8).alias("col"), phase.times_conj(z, phase.complex_of(F.cos(f), -F.sin(f))).alias("z"), phase.power(phase.complex_of(c("r1"), c("i1"))).alias("p1"), phase.power(phase.complex_of(c("r2"), c("i2"))).alias("p2"))
    looks = turned.groupBy("row", "col").agg(F.avg("z.re").alias("re"), F.avg("z.im").alias("im"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"))
    size = F.sqrt(c("re") * c("re") + c("im") * c("im"))
    return looks.select("row", "col", _R(phase.wrap(F.atan2("im", "re")), 5).alias("phi"), _R(size / (F.sqrt(c("p1") * c("p2")) + 1e-10), 6).alias("coherence"))


_TIMING = predict.Timing(-20.0, 40.0, 850_000.0, 60.0, 64, 2048)


@query()
def geometry_prediction(spark, sf_dir):
    """Incidence and range difference against a shifted orbit at every pixel, from polynomials."""
    orbit = circular_orbit()
    moved = orbit.coefficients.copy()
    moved[0] += [120.0, -80.0, 50.0]
    p = predict.Predictor.fit(orbit, _TIMING, [type(orbit)(orbit.start, orbit.end, moved)])
    return pixels(spark, sf_dir).select("row", "col", *(_R(p.column(k, c("row"), c("col")), 6).alias(k) for k in ("incidence", "delta_r_0", "b_perp_0")))


@query()
def atmosphere_spline(spark, sf_dir):
    """Smooth surfaces of the raster's bands, one a date, with the plane of each."""
    r = pixels(spark, sf_dir)
    p = r.select((c("row") % 4).alias("date"), F.floor(c("row") / 4).alias("row"), "col", c("v").alias("value"), F.lit(1.0).alias("weight"))
    h = int(p.agg(F.max("row")).first()[0]) + 1
    planes = p.select("date").distinct().select("date", (c("date") * 0.1).alias("a"), F.lit(0.001).alias("by_row"), F.lit(-0.002).alias("by_col"))
    return spline.atmosphere(p, planes, h, 64).select("date", "row", "col", _R("value", 6).alias("value"))


@query()
def coarse_footprint(spark, sf_dir):
    """Bounds of what a height model has to cover, for products of one orbit."""
    orbit = circular_orbit()
    t = [orbit.start + 10.0 * k for k in range(17)]
    states = [tuple(map(float, (s, *orbit.at([s])[0], *orbit.at([s], 1)[0]))) for s in t]
    one = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("t", "x", "y", "z", "vx", "vy", "vz"), s, strict=True))) for s in states))
    k = c("p_partkey")
    # dealt to tasks while rows are short
    products = table(spark, sf_dir, "part").select("p_partkey").repartition(k).select(k.alias("id"), one.alias("states"), (k % 90 - 45).alias("first_azt"), F.lit(400.0).alias("azimuth_frequency"), (830_000 + k % 50 * 400).alias("first_rng"), F.lit(2.5).alias("range_step"), F.lit(9000).alias("w"), F.lit(3000).alias("h"))
    return predict.bounds(predict.coarse_footprints(products)).select("id", *(_R(v, 5).alias(v) for v in ("lon_min", "lon_max", "lat_min", "lat_max")))


_SURFACE = "0.11 * row + 0.0007 * row * col - 0.4 * col + 3 * sin(row / 40.0)"


@query(f"WITH {RASTER}, f AS (SELECT row, col, {_SURFACE} AS f FROM raster), o AS (SELECT f AS f0 FROM f WHERE row = 0 AND col = 0) SELECT row, col, round(f - f0, 4) AS u FROM f, o")
def unwrap_tiles(spark, sf_dir):
    """A surface found again from its wrapped phase, tile by tile after the slopes of its lines, which pass half a turn a pixel further down; up to its first value."""
    f = 0.11 * c("row") + 0.0007 * c("row") * c("col") - 0.4 * c("col") + 3 * F.sin(c("row") / 40.0)
    done = kernels.unwrapped_steep(pixels(spark, sf_dir).select("row", "col", phase.wrap(f).alias("phi")), _written, 32)
    first = done.where("row = 0 and col = 0").select(c("unwrapped").alias("u0"))
    return done.join(F.broadcast(first), c("u0").isNotNull()).select("row", "col", _R(c("unwrapped") - c("u0"), 4).alias("u"))
