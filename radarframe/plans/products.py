"""Queries on registration, mosaics, slices, ground-range crops and interferograms of a stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from radarframe.operators import bursts, pipelines, registration
from radarframe.plans.catalogue import query, table
from radarframe.plans.pixels import PAIR, RASTER, pairs, pixels


c = F.col
_R = F.round


@query(
    f"""WITH {PAIR}, im AS (SELECT row % 3 AS date, row // 3 AS row, col, r1 AS re, i1 AS im, (row % 3 - 1) * 0.03 * (row // 3) AS f FROM pair WHERE row % 3 < 3),
    t AS (SELECT date, row, col, re * cos(f) - im * sin(f) AS re, re * sin(f) + im * cos(f) AS im FROM im),
    z AS (SELECT a.date AS date1, b.date AS date2, a.row // 2 AS row, a.col // 8 AS col, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im, avg(a.re * a.re + a.im * a.im) AS p, avg(b.re * b.re + b.im * b.im) AS q
      FROM t a JOIN t b ON a.row = b.row AND a.col = b.col AND a.date < b.date GROUP BY 1, 2, 3, 4)
    SELECT date1, date2, row, col, round(re, 6) AS re, round(im, 6) AS im, round(sqrt(re * re + im * im) / (sqrt(p * q) + 1e-10), 6) AS coherence FROM z"""
)
def interferogram_pairs(spark, sf_dir):
    """All pairs of three images, flattened by each date's simulated phase."""
    im = pairs(spark, sf_dir).select((c("row") % 3).alias("date"), F.floor(c("row") / 3).alias("row"), "col", c("r1").alias("re"), c("i1").alias("im"))
    phi = im.select("date", "row", "col", ((c("date") - 1) * 0.03 * c("row")).alias("phi"))
    d = im.select("date").distinct()
    two = d.select(c("date").alias("date1")).join(d.select(c("date").alias("date2")), c("date1") < c("date2"))
    return pipelines.interferograms(im, two, [phi]).select("date1", "date2", "row", "col", *(_R(k, 6).alias(k) for k in ("re", "im", "coherence")))


@query(
    f"""WITH {RASTER}, sl AS (SELECT s AS slice_id, 2.25 AS dx, s * 40 + 0.5 AS dy, 60 AS w, 50 AS h FROM (SELECT DISTINCT row // 40 AS s FROM raster)),
    sim AS (SELECT slice_id, row - slice_id * 40 AS row, col, v * v * 40 + 0.02 AS v FROM raster JOIN sl ON row >= slice_id * 40 AND row < slice_id * 40 + 50 AND col < 60),
    places AS (SELECT slice_id, row AS i, col AS j, row - dy AS y, col - dx AS x FROM raster JOIN sl ON row >= CAST(floor(dy) AS INT) AND row < CAST(floor(dy) AS INT) + h - 1 AND col >= 2 AND col < 62),
    k AS (SELECT slice_id, i, j, floor(y) + di AS row, floor(x) + dj AS col, (CASE di WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE dj WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM places, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)),
    got AS (SELECT slice_id, i, j, CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 1 - 1e-9 THEN sum(w * v) END AS v FROM k LEFT JOIN sim USING (slice_id, row, col) WHERE w > 0 GROUP BY 1, 2, 3),
    own AS (SELECT * FROM (SELECT *, min(CASE WHEN v IS NOT NULL THEN slice_id END) OVER (PARTITION BY i) AS o FROM got) WHERE slice_id = o)
    SELECT raster.row, raster.col, slice_id, round(CASE WHEN slice_id IS NULL THEN abs(raster.v) WHEN own.v < 0.05 THEN 0 ELSE sqrt(raster.v * raster.v / (own.v + 1e-30)) END, 6) AS amp FROM raster LEFT JOIN own ON raster.row = i AND raster.col = j"""
)
def rtc_slices(spark, sf_dir):
    """An image normalised by overlapping slices, each line by the first slice that has it."""
    r = pixels(spark, sf_dir)
    s = r.select(F.floor(c("row") / 40).alias("slice_id")).distinct().select("slice_id", F.lit(2.25).alias("dx"), (c("slice_id") * 40 + 0.5).alias("dy"), F.lit(60).alias("w"), F.lit(50).alias("h"))
    holds = F.filter(F.array(F.floor(c("row") / 40), F.floor(c("row") / 40) - 1), lambda k: (k >= 0) & (c("row") < k * 40 + 50))
    sim = r.where("col < 60").select("row", "col", "v", F.explode(holds).alias("slice_id")).select("slice_id", (c("row") - c("slice_id") * 40).alias("row"), "col", (c("v") * c("v") * 40 + 0.02).alias("v"))
    done = pipelines.normalized_by_slices(r.select("row", "col", F.abs("v").alias("amp")), s, sim)
    return done.select("row", "col", "slice_id", _R("amp", 6).alias("amp"))


@query(
    f"""WITH {RASTER}, dn AS (SELECT row, col, CASE WHEN col < row % 5 THEN 0 ELSE abs(v) * 100 END AS dn, 2 + col * 0.1 AS noise, 10 + row * 0.01 AS factor FROM raster),
    m AS (SELECT row, col, greatest((dn * dn - noise) / (factor * factor), 0) AS sigma, min(CASE WHEN dn > 0 THEN col END) OVER (PARTITION BY row) AS c0, min(CASE WHEN dn > 0 THEN row END) OVER (PARTITION BY col) AS r0 FROM dn),
    g AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 100 AS BIGINT) AS row, CAST(c_custkey * 53 % 70 AS BIGINT) AS col FROM customer)
    SELECT id, round(CASE WHEN m.col >= c0 AND m.row >= r0 THEN sigma END, 6) AS sigma FROM g LEFT JOIN m USING (row, col)"""
)
def grd_crop(spark, sf_dir):
    """Calibrated, without the border, on the ground."""
    r = pixels(spark, sf_dir)
    dn = r.select(F.lit(7).alias("datatake"), "row", "col", F.when(c("col") < c("row") % 5, 0.0).otherwise(F.abs("v") * 100).alias("dn"), (2 + c("col") * 0.1).alias("noise"), (10 + c("row") * 0.01).alias("factor"))
    k = c("c_custkey")
    g = table(spark, sf_dir, "customer").select(k.alias("row"), F.lit(0).alias("col"), (k * 37 % 100).cast("double").alias("y"), (k * 53 % 70).cast("double").alias("x"))
    return pipelines.ground_range_crop(dn, g, nearest=True).select(c("row").alias("id"), _R("sigma", 6).alias("sigma"))


@query(
    f"""WITH {RASTER}, b AS (SELECT row // 50 AS burst, row % 50 AS y, col AS x, v FROM raster), n AS (SELECT max(burst) AS top FROM b)
    SELECT burst * 40 + y - 5 AS row, x - 4 AS col, round(v, 6) AS v FROM b, n WHERE x BETWEEN 4 AND 59 AND y >= CASE WHEN burst = 0 THEN 0 ELSE 5 END AND y < CASE WHEN burst = top THEN 50 ELSE 45 END
      AND burst * 40 + y >= 5 AND burst * 40 + y < 5 + 10000"""
)
def deburst_mosaic(spark, sf_dir):
    """Bursts of fifty lines that overlap by ten, put together for a rectangle."""
    r = pixels(spark, sf_dir).select(F.lit("a").alias("acquisition"), F.lit("iw1").alias("swath"), F.floor(c("row") / 50).alias("burst"), (c("row") % 50).alias("row"), "col", "v")
    each = r.select("acquisition", "swath", "burst").distinct().select("*", F.lit(0).alias("col"), (c("burst") * 40).cast("int").alias("row"), F.lit(64).alias("w"), F.lit(50).alias("h"), (c("burst") * 40.0).alias("start"), (c("burst") * 40.0 + 50).alias("end"))
    parts = bursts.stitched(bursts.cut(each, 1.0), (4, 5, 56, 10000))
    return registration.mosaic(r, parts, ["v"]).select("row", "col", _R("v", 6).alias("v"))


@query(
    f"""WITH im AS (SELECT p_partkey % 7 AS id, p_partkey // 7 % 40 AS x, p_partkey % 53 AS y FROM part), m AS (SELECT DISTINCT id, CAST(3 + id AS DOUBLE) AS tx, CAST(2 * id - 5 AS DOUBLE) AS ty FROM im)
    SELECT id, round(1.0, 5) AS a, round(0.0, 5) AS b, round(tx, 4) AS c, round(0.0, 5) AS d, round(1.0, 5) AS e, round(ty, 4) AS f FROM m"""
)
def registration_affines(spark, sf_dir):
    """Maps recovered from matched places: each image is the primary moved by its own translation."""
    k = c("p_partkey")
    m = table(spark, sf_dir, "part").select((k % 7).alias("id"), (F.floor(k / 7) % 40).cast("double").alias("col"), (k % 53).cast("double").alias("row"))
    m = m.select("id", "col", "row", (c("col") + 3 + c("id")).alias("to_col"), (c("row") + 2 * c("id") - 5).alias("to_row"))
    got = registration.affines(m, ["id"])
    return got.select("id", *((_R(F.get("matrix", F.lit(n)), 5 if n not in (2, 5) else 4) + 0.0).alias(k) for n, k in enumerate("abcdef")))
