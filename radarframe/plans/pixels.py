"""Queries on rasters and complex pairs derived from ``embeddings``, and on points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import images, joins, raster
from radarframe.plans.catalogue import query, table

RASTER = "raster AS (SELECT vec_id AS row, i - 1 AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
PAIR = """pair AS (SELECT a.vec_id // 2 AS row, i - 1 AS col, CAST(a.embedding[i] AS DOUBLE) AS r1, CAST(a.embedding[i + 32] AS DOUBLE) AS i1,
  CAST(b.embedding[i] AS DOUBLE) AS r2, CAST(b.embedding[i + 32] AS DOUBLE) AS i2
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0, (SELECT unnest(range(1, 33)) AS i))"""
TAU = "(2 * pi())"


def sql_wrap(x: str) -> str:
    return f"((({x}) + pi()) - {TAU} * floor((({x}) + pi()) / {TAU}) - pi())"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 2).cast("long").alias("row"), (F.col("vec_id") % 2).alias("k"), "embedding")
    both = e.groupBy("row").agg(F.max(F.when(F.col("k") == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("embedding"))).alias("b")).where("a is not null and b is not null")
    cell = both.select("row", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("col"))
    get = lambda c, k: F.get(c, F.col("col") + k).cast("double")
    return cell.select("row", F.col("col").cast("long").alias("col"), get("a", 0).alias("r1"), get("a", 32).alias("i1"), get("b", 0).alias("r2"), get("b", 32).alias("i2"))


@query(f"WITH {RASTER} SELECT row, col, round({sql_wrap('v * 7')}, 6) AS phi FROM raster")
def phase_wrap(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", F.round(phase.wrap(F.col("v") * 7), 6).alias("phi"))


@query(f"WITH {PAIR} SELECT row, col, round(r1 * r2 + i1 * i2, 6) AS re, round(i1 * r2 - r1 * i2, 6) AS im, round(sqrt(power(r1 * r2 + i1 * i2, 2) + power(i1 * r2 - r1 * i2, 2)), 6) AS amp FROM pair")
def interferogram(spark, sf_dir):
    z = phase.times_conj(phase.complex_of(F.col("r1"), F.col("i1")), phase.complex_of(F.col("r2"), F.col("i2")))
    return pairs(spark, sf_dir).select("row", "col", z.alias("z")).select("row", "col", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"), F.round(F.sqrt(phase.power(F.col("z"))), 6).alias("amp"))


def _box(cols: list[str], hr: int, hc: int, source: str) -> str:
    w1 = f"(PARTITION BY row ORDER BY col RANGE BETWEEN {hc} PRECEDING AND {hc} FOLLOWING)"
    w2 = f"(PARTITION BY col ORDER BY row RANGE BETWEEN {hr} PRECEDING AND {hr} FOLLOWING)"
    one = ", ".join(f"sum({c}) OVER {w1} AS s_{c}, count({c}) OVER {w1} AS n_{c}" for c in cols)
    two = ", ".join(f"sum(s_{c}) OVER {w2} / sum(n_{c}) OVER {w2} AS mean_{c}" for c in cols)
    return f"h AS (SELECT *, {one} FROM {source}), box AS (SELECT *, {two} FROM h)"


@query(f"WITH {RASTER}, {_box(['v'], 1, 2, 'raster')} SELECT row, col, round(mean_v, 6) AS mean FROM box")
def box_filter(spark, sf_dir):
    return raster.box_mean(pixels(spark, sf_dir), ["v"], 1, 2).select("row", "col", F.round("mean_v", 6).alias("mean"))


_CROSS = "x AS (SELECT row, col, r1 * r2 + i1 * i2 AS re, i1 * r2 - r1 * i2 AS im, r1 * r1 + i1 * i1 AS p1, r2 * r2 + i2 * i2 AS p2 FROM pair)"


@query(f"WITH {PAIR}, {_CROSS}, {_box(['re', 'im', 'p1', 'p2'], 1, 2, 'x')} SELECT row, col, round(sqrt(mean_re * mean_re + mean_im * mean_im) / (sqrt(mean_p1 * mean_p2) + 1e-10), 6) AS coherence FROM box")
def coherence_pair(spark, sf_dir):
    return images.coherence(pairs(spark, sf_dir), 1, 2).select("row", "col", F.round("coherence", 6).alias("coherence"))


def _replicated(cols: list[str], hr: int, hc: int, source: str) -> str:
    def one(x: str, half: int, w: str) -> str:
        ends = {k: f"{f}_value({x}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for k, f in ((-1, "first"), (1, "last"))}
        return "(" + " + ".join(f"coalesce(lag({x}, {-k}) OVER ({w}), {ends[1 if k > 0 else -1]})" if k else x for k in range(-half, half + 1)) + f") / {2 * half + 1}"

    across, down = "PARTITION BY row ORDER BY col", "PARTITION BY col ORDER BY row"
    return f"h AS (SELECT row, col, {', '.join(f'{one(k, hc, across)} AS h_{k}' for k in cols)} FROM {source}), box AS (SELECT row, col, {', '.join(f'{one(f"h_{k}", hr, down)} AS mean_{k}' for k in cols)} FROM h)"


_COHERENCE = "sqrt(mean_re * mean_re + mean_im * mean_im) / (sqrt(mean_p1 * mean_p2) + 1e-10)"


@query(f"WITH {PAIR}, {_CROSS}, {_replicated(['re', 'im', 'p1', 'p2'], 1, 2, 'x')} SELECT row, col, round({_COHERENCE}, 6) AS coherence FROM box")
def coherence_replicated(spark, sf_dir):
    """Edge pixels stand for those beyond them."""
    return images.coherence(pairs(spark, sf_dir), 1, 2, "replicate").select("row", "col", F.round("coherence", 6).alias("coherence"))


@query(
    f"WITH {PAIR}, {_CROSS}, {_box(['re', 'im', 'p1', 'p2'], 1, 2, 'x')}, s AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM x)"
    f" SELECT row, col, CASE WHEN row - r0 >= 1 AND r1 - row >= 1 AND col - c0 >= 2 AND c1 - col >= 2 THEN round({_COHERENCE}, 6) END AS coherence FROM box, s"
)
def coherence_inner(spark, sf_dir):
    """Only where the window is whole."""
    done = images.coherence(pairs(spark, sf_dir), 1, 2, "nan")
    return done.select("row", "col", F.round(F.nanvl("coherence", F.lit(None).cast("double")), 6).alias("coherence"))


@query(f"WITH {PAIR}, {_CROSS}, {_box(['re', 'im'], 1, 4, 'x')} SELECT row, col, round(mean_re, 6) AS re, round(mean_im, 6) AS im FROM box WHERE row % 2 = 0 AND col % 8 = 0")
def multilook_stride(spark, sf_dir):
    done = images.multilooked(images.crossed(pairs(spark, sf_dir)), ["re", "im"], 1, 4, 2, 8)
    return done.select("row", "col", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"WITH {RASTER} SELECT row // 2 AS brow, col // 8 AS bcol, round(avg(v), 6) AS mean, count(*) AS n FROM raster GROUP BY 1, 2")
def block_mean(spark, sf_dir):
    return images.block_means(pixels(spark, sf_dir), "v", 2, 8).select("brow", "bcol", F.round("mean", 6).alias("mean"), "n")


def _extreme(f: str) -> str:
    return f"""WITH {RASTER}, h AS (SELECT *, {f}(v) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM raster),
      k AS (SELECT *, {f}(e) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM h) SELECT row, col, round(v, 6) AS v FROM k WHERE v = m"""


@query(_extreme("min"))
def local_min(spark, sf_dir):
    return raster.local_extreme(pixels(spark, sf_dir), "v", "m").where("v = m").select("row", "col", F.round("v", 6).alias("v"))


#: Pixels inside the image whose eight neighbours are smaller, or as large and later.
_FIRST_MAX = f"""WITH {RASTER}, k AS (SELECT a.row, a.col, a.v FROM raster a JOIN raster b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (b.row <> a.row OR b.col <> a.col)
      GROUP BY a.row, a.col, a.v HAVING count(*) = 8 AND bool_and(CASE WHEN b.row < a.row OR b.row = a.row AND b.col < a.col THEN b.v < a.v ELSE b.v <= a.v END)) SELECT row, col, round(v, 6) AS v FROM k"""


@query(_FIRST_MAX)
def local_max(spark, sf_dir):
    return images.first_maxima(pixels(spark, sf_dir), "v").select("row", "col", F.round("v", 6).alias("v"))


@query(_FIRST_MAX + " ORDER BY k.v DESC, row, col LIMIT 20")
def top_maxima(spark, sf_dir):
    return images.top(images.first_maxima(pixels(spark, sf_dir), "v"), "v", 20).select("row", "col", F.round("v", 6).alias("v"))


_SIDES = f"""{RASTER}, w AS (SELECT row, col, CASE WHEN col < row % 5 OR row > 90 + col % 4 THEN 0 ELSE v END AS v FROM raster WHERE row < 94),
  s AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM w),
  f AS (SELECT avg(CASE WHEN col = c0 THEN CAST(v > 0 AS INTEGER) END) < 0.5 AS fl, avg(CASE WHEN col = c1 THEN CAST(v > 0 AS INTEGER) END) < 0.5 AS fr, avg(CASE WHEN row = r0 THEN CAST(v > 0 AS INTEGER) END) < 0.5 AS ft,
    avg(CASE WHEN row = r1 THEN CAST(v > 0 AS INTEGER) END) < 0.5 AS fb FROM w, s)"""


def _sided(spark, sf_dir):
    hidden = (F.col("col") < F.col("row") % 5) | (F.col("row") > 90 + F.col("col") % 4)
    return pixels(spark, sf_dir).where("row < 94").select("row", "col", F.when(hidden, 0.0).otherwise(F.col("v")).alias("v"))


@query(f'WITH {_SIDES} SELECT fl AS "left", fr AS "right", ft AS top, fb AS bottom FROM f')
def edge_flags(spark, sf_dir):
    return images.edge_flags(_sided(spark, sf_dir), "v")


@query(
    f"""WITH {_SIDES}, m AS (SELECT *, min(CASE WHEN v > 0 THEN col END) OVER (PARTITION BY row) AS a, max(CASE WHEN v > 0 THEN col END) OVER (PARTITION BY row) AS b,
    min(CASE WHEN v > 0 THEN row END) OVER (PARTITION BY col) AS c, max(CASE WHEN v > 0 THEN row END) OVER (PARTITION BY col) AS d FROM w)
    SELECT row, col, (NOT fl OR coalesce(col >= a, false)) AND (NOT fr OR coalesce(col <= b, false)) AND (NOT ft OR coalesce(row >= c, false)) AND (NOT fb OR coalesce(row <= d, false)) AS inside FROM m, f"""
)
def border_masks(spark, sf_dir):
    """All four sides, where they are flagged."""
    return images.border_masks(_sided(spark, sf_dir), "v").select("row", "col", "inside")


@query(
    f"""WITH {RASTER}, p AS (SELECT row, col, {sql_wrap('v * 7')} AS phi FROM raster),
    g AS (SELECT *, {sql_wrap('lead(phi) OVER (PARTITION BY row ORDER BY col) - phi')} AS gx, {sql_wrap('lead(phi) OVER (PARTITION BY col ORDER BY row) - phi')} AS gy FROM p),
    l AS (SELECT *, lead(gx) OVER (PARTITION BY col ORDER BY row) AS gxb, lead(gy) OVER (PARTITION BY row ORDER BY col) AS gyr FROM g)
    SELECT row, col, round(gx, 6) AS gx, round(gy, 6) AS gy, CAST(round((gx + gyr - gxb - gy) / (-2 * pi())) AS INTEGER) AS residue FROM l"""
)
def phase_gradient_residue(spark, sf_dir):
    p = pixels(spark, sf_dir).select("row", "col", phase.wrap(F.col("v") * 7).alias("phi"))
    return raster.residues(p, phase.wrap).select("row", "col", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"), "residue")


@query(
    f"""WITH {RASTER}, p AS (SELECT row, col, {sql_wrap('v + row * 0.3 + col * 0.2')} AS phi FROM raster),
    x AS (SELECT *, coalesce({sql_wrap('phi - lag(phi) OVER (PARTITION BY row ORDER BY col)')}, 0) AS dx FROM p),
    f AS (SELECT row, phi, coalesce({sql_wrap('phi - lag(phi) OVER (ORDER BY row)')}, 0) AS dy FROM p WHERE col = 0),
    y AS (SELECT row, sum(dy) OVER (ORDER BY row) + first_value(phi) OVER (ORDER BY row) AS y FROM f)
    SELECT row, col, round(sum(dx) OVER (PARTITION BY row ORDER BY col) + y, 5) AS unwrapped FROM x JOIN y USING (row)"""
)
def integrate_gradient(spark, sf_dir):
    p = pixels(spark, sf_dir).select("row", "col", phase.wrap(F.col("v") + F.col("row") * 0.3 + F.col("col") * 0.2).alias("phi"))
    return raster.integrated(p, phase.wrap).select("row", "col", F.round("unwrapped", 5).alias("unwrapped"))


@query(
    f"""WITH {RASTER}, m AS (SELECT *, min(CASE WHEN v > 0 THEN col END) OVER (PARTITION BY row) AS fc, min(CASE WHEN v > 0 THEN row END) OVER (PARTITION BY col) AS fr FROM raster)
    SELECT row, col, coalesce(col >= fc AND row >= fr, false) AS inside FROM m"""
)
def border_mask(spark, sf_dir):
    return raster.border_mask(pixels(spark, sf_dir), "v").select("row", "col", "inside")


@query(f"WITH {RASTER}, s AS (SELECT *, max(v) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM raster) SELECT row, col, v >= m AS lit FROM s")
def shadow_running_max(spark, sf_dir):
    return raster.shadow(pixels(spark, sf_dir), "v").select("row", "col", "lit")


@query(
    f"""WITH {RASTER}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM raster)
    SELECT row, col, CAST(trunc(least(greatest((v - lo) / (hi - lo), 0), 1) * 255) AS INTEGER) AS level FROM raster, q"""
)
def percentile_stretch(spark, sf_dir):
    p = pixels(spark, sf_dir)
    low, high = images.percentiles(p, "v", [0.02, 0.98])
    return images.stretched(p, "v", low, high).select("row", "col", "level")


@query(
    f"""WITH {RASTER} SELECT count(*) AS n, round(avg(v), 6) AS mv, round(avg(row), 6) AS mr, round(avg(col), 6) AS mc, round(sum(v * v), 4) AS svv,
    round(sum(v * row), 3) AS svr, round(sum(v * col), 4) AS svc FROM raster"""
)
def affine_moments(spark, sf_dir):
    p = pixels(spark, sf_dir)
    c = F.col
    return p.agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mv"), F.round(F.avg("row"), 6).alias("mr"), F.round(F.avg("col"), 6).alias("mc"),
        F.round(F.sum(c("v") * c("v")), 4).alias("svv"), F.round(F.sum(c("v") * c("row")), 3).alias("svr"), F.round(F.sum(c("v") * c("col")), 4).alias("svc"),
    )


@query(
    f"""WITH {RASTER}, n AS (SELECT max(row) AS top FROM raster), p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000) / 1000.0 * top AS y, (c_custkey * 53 % 1000) / 1000.0 * 62 AS x FROM customer, n),
    k AS (SELECT id, y, x, floor(y) + i AS row, floor(x) + j AS col, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
      FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT id, round(sum(w * v), 5) AS value, count(*) AS corners FROM k JOIN raster USING (row, col) GROUP BY id"""
)
def dem_bilinear(spark, sf_dir):
    r = pixels(spark, sf_dir)
    top = r.agg(F.max("row").alias("top"))
    p = table(spark, sf_dir, "customer").crossJoin(F.broadcast(top)).select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1000 / 1000.0 * F.col("top")).alias("y"), (F.col("c_custkey") * 53 % 1000 / 1000.0 * 62).alias("x")
    )
    return raster.bilinear(r, p, "v").select("id", F.round("value", 5).alias("value"), "corners")


POINTS = "pt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0 - 80 AS lat, c_acctbal AS alt FROM customer)"


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 36000 / 100.0 - 180).alias("lon"), (k * 104729 % 16000 / 100.0 - 80).alias("lat"), F.col("c_acctbal").alias("alt"))


@query(
    f"""WITH {POINTS}, n AS (SELECT *, {phase.WGS84_A} / sqrt(1 - {phase.WGS84_E2} * power(sin(radians(lat)), 2)) AS n FROM pt)
    SELECT id, round((n + alt) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n + alt) * cos(radians(lat)) * sin(radians(lon)), 3) AS y,
    round((n * (1 - {phase.WGS84_E2}) + alt) * sin(radians(lat)), 3) AS z FROM n"""
)
def ecef_forward(spark, sf_dir):
    x, y, z = phase.ecef(F.col("lon"), F.col("lat"), F.col("alt"))
    return points(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query(f"WITH {POINTS} SELECT id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS BIGINT) AS epsg FROM pt")
def utm_zone(spark, sf_dir):
    return points(spark, sf_dir).select("id", phase.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(
    f"""WITH {POINTS} SELECT id, round((alt * alt / 8.55e7 - alt / 3411.0 + 2.41) / cos(radians(30 + id % 15)), 6) AS delay,
    round(-4 * pi() / 0.0556 * alt * (id % 200 - 100.5) / (850000.0 * sin(radians(30 + id % 15))), 6) AS topo, round(-4 * pi() / 0.0556 * (id % 50 + 1), 6) AS flat FROM pt"""
)
def atmosphere_and_topography(spark, sf_dir):
    inc = F.radians(30 + F.col("id") % 15)
    return points(spark, sf_dir).select(
        "id", F.round(phase.path_delay(F.col("alt"), inc), 6).alias("delay"),
        F.round(phase.topographic(F.col("alt"), F.col("id") % 200 - 100.5, F.lit(850000.0), inc, 0.0556), 6).alias("topo"),
        F.round(phase.flat_earth(F.col("id") % 50 + 1, 0.0556), 6).alias("flat"),
    )


@query(
    f"""WITH {RASTER} SELECT row, col, round(greatest((v * v - 0.01) / 4, 0), 6) AS clipped, round(CASE WHEN (v * v - 0.01) / 4 < 0 THEN v * v / 4 ELSE (v * v - 0.01) / 4 END, 6) AS kept,
    round(CASE WHEN abs(v) * 2 < 0.05 THEN 0 ELSE sqrt(v * v / (abs(v) * 2 + 1e-30)) END, 6) AS rtc FROM raster"""
)
def calibrate(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select(
        "row", "col", F.round(phase.calibrated(v, F.lit(0.01), F.lit(2.0)), 6).alias("clipped"), F.round(phase.calibrated(v, F.lit(0.01), F.lit(2.0), clip=False), 6).alias("kept"),
        F.round(phase.rtc_normalized(F.abs(v), F.abs(v) * 2), 6).alias("rtc"),
    )


@query(f"WITH {RASTER} SELECT row, col, round(0.5 + v * (-1.25 + v * (2.0 + v * 0.125)), 6) AS y FROM raster")
def horner_eval(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", F.round(phase.horner([0.5, -1.25, 2.0, 0.125], F.col("v")), 6).alias("y"))


@query(
    """WITH p AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7919 % 997 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 991 AS DOUBLE) AS y FROM supplier)
    SELECT a.id AS a, b.id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS dist FROM p a JOIN p b ON a.id <> b.id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 60"""
)
def ps_neighbors(spark, sf_dir):
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7919 % 997).cast("double").alias("x"), (k * 104729 % 991).cast("double").alias("y"))
    return joins.within_distance(p, 60.0).select("a", "b", F.round("dist", 6).alias("dist"))


@query(f"WITH {POINTS} SELECT id, round((degrees(atan2(lon, lat)) + 360) % 360, 6) AS azimuth, round(degrees(acos(-sin(radians(lat)))), 6) AS incidence FROM pt")
def los_angles(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(phase.los_azimuth(F.col("lon"), F.col("lat")), 6).alias("azimuth"), F.round(phase.los_incidence(F.sin(F.radians("lat"))), 6).alias("incidence"))


@query(
    """SELECT c_custkey AS id, CASE WHEN hit THEN c0 ELSE 0 END AS col, CASE WHEN hit THEN r0 ELSE 0 END AS row, CASE WHEN hit THEN c1 - c0 ELSE 0 END AS w, CASE WHEN hit THEN r1 - r0 ELSE 0 END AS h
    FROM (SELECT *, c1 > c0 AND r1 > r0 AS hit FROM (SELECT c_custkey, CAST(greatest(c_custkey % 300, 100) AS INTEGER) AS c0, CAST(greatest(c_custkey % 170, 50) AS INTEGER) AS r0,
      CAST(least(c_custkey % 300 + 64, 228) AS INTEGER) AS c1, CAST(least(c_custkey % 170 + 32, 114) AS INTEGER) AS r1 FROM customer))"""
)
def roi_clip(spark, sf_dir):
    k = F.col("c_custkey")
    a = F.struct((k % 300).alias("col"), (k % 170).alias("row"), F.lit(64).alias("w"), F.lit(32).alias("h"))
    b = F.struct(F.lit(100).alias("col"), F.lit(50).alias("row"), F.lit(128).alias("w"), F.lit(64).alias("h"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), phase.clip_roi(a, b).alias("r")).select("id", "r.col", "r.row", "r.w", "r.h")
