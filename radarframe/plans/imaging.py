"""Queries on resampling with ramps, unwrapping of whole rasters, chunked files and projections burst by burst."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import resampling, unwrapping
from radarframe.plans.catalogue import query, table
from radarframe.plans.dense import _sinc_weights
from radarframe.plans.pixels import PAIR, pairs
from radarframe.plans.series import _written, shared_folder
from radarframe.sources import hdf5

c = F.col
_R = F.round

#: A burst's ramp by image: FM rate and centroid linear in slant range.
_FRAME = dict(t0=-0.12, dt=1 / 486.0, tau0=5.3e-3, dtau=1 / 64e6, mid_tau=5.3e-3 + 16 / 64e6, ks=1700.0, fm_tau=5.3e-3, dc_tau=5.3e-3)
_RAMPS = {1: _FRAME | dict(fm=[-2300.0, 4e6], dc=[[-40.0, 3e7]]), 2: _FRAME | dict(fm=[-2280.0, 3e6], dc=[[25.0, -2e7]])}
_TO = (0.25, 0.6)


def _ramp_sql(row: str, col: str) -> str:
    f = _FRAME
    pick = lambda k, i: f"CASE id WHEN 1 THEN {(_RAMPS[1][k][0] if k == 'dc' else _RAMPS[1][k])[i]!r} ELSE {(_RAMPS[2][k][0] if k == 'dc' else _RAMPS[2][k])[i]!r} END"
    at = lambda k, tau: f"(({pick(k, 0)}) + ({pick(k, 1)}) * ({tau} - {f['fm_tau']!r}))"
    t, tau, mid = f"({f['t0']!r} + {f['dt']!r} * ({row}))", f"({f['tau0']!r} + {f['dtau']!r} * ({col}))", repr(f["mid_tau"])
    late = f"({t} - ({at('dc', mid)} / {at('fm', mid)} - {at('dc', tau)} / {at('fm', tau)}))"
    return f"((pi() * {at('fm', tau)} * {f['ks']!r} / ({at('fm', tau)} - {f['ks']!r}) * {late} + 2 * pi() * {at('dc', tau)}) * {late})"


@query(
    f"""WITH {PAIR}, i AS (SELECT 1 AS id, row, col, r1 AS re, i1 AS im FROM pair UNION ALL SELECT 2, row, col, r2, i2 FROM pair),
    wy(i, w) AS (VALUES {', '.join(f'({k - 3}, {w!r})' for k, w in enumerate(_sinc_weights(_TO[0])))}), wx(j, w) AS (VALUES {', '.join(f'({k - 3}, {w!r})' for k, w in enumerate(_sinc_weights(_TO[1])))}),
    a AS (SELECT *, {_ramp_sql('row', 'col')} AS f FROM i), d AS (SELECT id, row, col, re * cos(f) + im * sin(f) AS re, im * cos(f) - re * sin(f) AS im FROM a),
    h AS (SELECT id, row, col - j AS col, sum(re * w) AS re, sum(im * w) AS im FROM d, wx GROUP BY 1, 2, 3 HAVING count(*) = 8),
    k AS (SELECT id, row - i AS row, col, sum(re * w) AS re, sum(im * w) AS im FROM h, wy GROUP BY 1, 2, 3 HAVING count(*) = 8),
    z AS (SELECT *, {_ramp_sql(f'row + {_TO[0]}', f'col + {_TO[1]}')} AS f FROM k),
    q AS (SELECT DISTINCT row, col FROM pair WHERE row >= 3 AND col >= 2)
    SELECT i.id, q.row, q.col, round(z.re * cos(z.f) - z.im * sin(z.f), 5) AS re, round(z.im * cos(z.f) + z.re * sin(z.f), 5) AS im FROM q CROSS JOIN (VALUES (1), (2)) i(id) LEFT JOIN z ON z.id = i.id AND z.row = q.row AND z.col = q.col"""
)
def deramped_resample(spark, sf_dir):
    """Both images of a pair moved by part of a pixel, each without its steering ramp while it is interpolated."""
    p = pairs(spark, sf_dir)
    images = p.select(F.lit(1).alias("id"), "row", "col", c("r1").alias("re"), c("i1").alias("im")).unionByName(p.select(F.lit(2).alias("id"), "row", "col", c("r2").alias("re"), c("i2").alias("im")))
    size = p.agg(F.max("row").alias("last"))  # one row
    maps = spark.createDataFrame([(k, [1.0, 0.0, _TO[1], 0.0, 1.0, _TO[0]], r) for k, r in _RAMPS.items()], f"id int, matrix array<double>, ramp {resampling.RAMP}")
    whole = F.struct(F.lit(2).alias("col"), F.lit(3).alias("row"), F.lit(30).alias("w"), (c("last") - 2).cast("int").alias("h"))
    moved = resampling.warped(images, maps.join(F.broadcast(size)).withColumn("rectangle", whole), ["id"], ["re", "im"], tile=64)
    return moved.select("id", "row", "col", *(_R(v, 5).alias(v) for v in ("re", "im")))


_SIDE = 24
_VORTICES = "s_suppkey * 7 % 23 AS r1, s_suppkey * 11 % 23 AS c1, (s_suppkey * 5 + 3) % 23 AS r2, (s_suppkey * 3 + 8) % 23 AS c2"
_WAY = "least({r} + 1, 23 - {r}, {c} + 1, 23 - {c})"


@query(
    f"""WITH v AS (SELECT s_suppkey AS id, {_VORTICES} FROM supplier)
    SELECT id, least(abs(r1 - r2) + abs(c1 - c2), {_WAY.format(r='r1', c='c1')} + {_WAY.format(r='r2', c='c2')}) AS cost, CAST({_SIDE * _SIDE} AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS off FROM v"""
)
def unwrap_residues(spark, sf_dir):
    """Images with a residue of either sign, unwrapped as whole rasters: the turns that neighbours of the surface are off by are the way between the residues, or theirs to the border."""
    v = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", *_VORTICES.split(", "))
    cell = v.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(_SIDE - 1))))
    turn = lambda k: F.atan2(c("row") - c(f"r{k}") - 0.5, c("col") - c(f"c{k}") - 0.5)
    done = unwrapping.unwrapped(cell.select("id", "row", "col", phase.wrap(turn(1) - turn(2)).alias("phi")), ["id"], _written)
    off = lambda x: F.abs(F.rint(x / (2 * F.pi())))
    jump = lambda axis, other: F.coalesce(off(c("unwrapped") - F.lag("unwrapped").over(w := Window.partitionBy("id", other).orderBy(axis)) - phase.wrap(c("phi") - F.lag("phi").over(w))), F.lit(0.0))
    each = done.select("id", (jump("row", "col") + jump("col", "row")).alias("n"), (F.abs(phase.wrap(c("unwrapped") - c("phi"))) > 1e-6).alias("wrong"))
    return each.groupBy("id").agg(F.sum("n").cast("long").alias("cost"), F.count("*").alias("pixels"), F.sum(c("wrong").cast("long")).alias("off"))


def _hdf5_files(spark, sf_dir) -> str:
    """The first image of each pair as complex rasters of 64 lines, a file each."""
    images = pairs(spark, sf_dir).select((c("row") / 64).cast("long").alias("id"), (c("row") % 64).alias("row"), "col", "r1", "i1")
    made = hdf5.files(images, "science/swaths/HH", ("r1", "i1"), ["id"], (16, 8))
    folder = shared_folder(spark, "hdf5")
    hdf5.save(made.select(c("id").cast("string").alias("name"), "content"), folder)
    return folder


def _of_files(read):
    return read.select(F.regexp_extract("path", "([0-9]+)[.]h5$", 1).cast("long").alias("id"), "row", "col", *(_R(v, 6).alias(v) for v in ("re", "im")))


@query(f"WITH {PAIR} SELECT row // 64 AS id, row % 64 AS row, col, round(r1, 6) AS re, round(i1, 6) AS im FROM pair")
def hdf5_round_trip(spark, sf_dir):
    """Complex rasters written as chunked, deflated files and read back whole."""
    return _of_files(hdf5.pixels(spark, _hdf5_files(spark, sf_dir), "science/swaths/HH"))


@query(f"WITH {PAIR} SELECT row // 64 AS id, row % 64 AS row, col, round(r1, 6) AS re, round(i1, 6) AS im FROM pair WHERE row % 64 BETWEEN 10 AND 49 AND col BETWEEN 5 AND 24")
def hdf5_window(spark, sf_dir):
    """A window of every file, of whose chunks only those that meet it are read."""
    return _of_files(hdf5.pixels(spark, _hdf5_files(spark, sf_dir), "science/swaths/HH", (5, 10, 20, 40)))


_SERIES = [[0.5, -1.25, 2.0], [0.75, 0.125, -0.5], [-1.5, 0.25, 1.0]]
_T = {"chebyshev": ("1", "{v}", "(2 * {v} * {v} - 1)"), "legendre": ("1", "{v}", "((3 * {v} * {v} - 1) / 2)")}
_D = {"chebyshev": ("0", "1", "(4 * {v})"), "legendre": ("0", "1", "(3 * {v})")}


def _surface_sql(kind: str, over_x: dict, over_y: dict) -> str:
    return " + ".join(f"({_SERIES[i][j]}) * {over_x[kind][i].format(v='x')} * {over_y[kind][j].format(v='y')}" for i in range(3) for j in range(3))


@query(
    f"""WITH raster AS (SELECT vec_id AS row, i - 1 AS col, CAST(embedding[i] AS DOUBLE) AS x, (2.0 * (i - 1) - 63) / 63 AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
    SELECT row, col, {', '.join(f"round({_surface_sql(k, a, b)}, 6) AS {k}_{n}" for k in _T for n, a, b in (('value', _T, _T), ('dx', _D, _T), ('dy', _T, _D)))} FROM raster"""
)
def polynomial_surfaces(spark, sf_dir):
    """Chebyshev and Legendre series of two variables with both derivatives."""
    from radarframe.functions import polynomials
    from radarframe.plans.pixels import pixels

    p = pixels(spark, sf_dir).select("row", "col", c("v").alias("x"), polynomials.scaled(c("col").cast("double"), 0.0, 63.0).alias("y"), F.array(*(F.array(*map(F.lit, r)) for r in _SERIES)).alias("c"))
    done = p.select("row", "col", *(polynomials.surface(k, c("c"), c("x"), c("y")).alias(k) for k in _T))
    return done.select("row", "col", *(_R(f"{k}.{n}", 6).alias(f"{k}_{n}") for k in _T for n in ("value", "dx", "dy")))


@query(
    f"""WITH {PAIR}, d AS (SELECT 'd' || (row // 100) AS date, row, row % 100 // 2 AS r, col // 8 AS k, r1 * r1 + i1 * i1 AS p FROM pair), w AS (SELECT date FROM d GROUP BY 1 HAVING count(DISTINCT row) = 100)
    SELECT date, r AS row, k AS col, round(avg(p), 6) AS power FROM d JOIN w USING (date) GROUP BY 1, 2, 3"""
)
def resumable_stack(spark, sf_dir):
    """A stack of images by date, made in two runs of a driver: the second goes on behind the first one's stage. Dates that lack lines are logged and left out."""
    from radarframe.operators import driver

    images = pairs(spark, sf_dir).select(F.concat(F.lit("d"), (c("row") / 100).cast("long").cast("string")).alias("date"), (c("row") % 100).alias("row"), "col", (c("r1") * c("r1") + c("i1") * c("i1")).alias("p"))
    dates = [r["date"] for r in images.select("date").distinct().orderBy("date").collect()]  # acquisitions

    def power(_, some):
        own = images.where(c("date").isin(some))
        lines = own.groupBy("date").agg(F.countDistinct("row").alias("lines"))
        return own.join(lines, "date").select("date", "row", "col", "p", F.when(c("lines") < 100, "lines are missing").alias("problem"))

    def cells(tables, _):
        return tables["power"].groupBy("date", F.floor(c("row") / 2).alias("row"), F.floor(c("col") / 8).alias("col")).agg(F.avg("p").alias("power"))

    folder, stages = shared_folder(spark, "stack"), [driver.Stage("power", power), driver.Stage("cells", cells, ("power",))]
    driver.Run(spark, folder, stages).run(dates, until="power")
    run = driver.Run(spark, folder, stages)
    run.run(dates)
    return run.table("cells").select("date", "row", "col", _R("power", 6).alias("power"))


@query(
    """WITH raster AS (SELECT vec_id AS row, i - 1 AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    k AS (SELECT *, row_number() OVER (ORDER BY row, col) - 1 AS rank FROM raster WHERE v > 0), l AS (SELECT DISTINCT row FROM k)
    SELECT raster.row, raster.col, k.rank, round(k.v, 6) AS v FROM raster JOIN l USING (row) LEFT JOIN k ON k.row = raster.row AND k.col = raster.col"""
)
def mask_ranks(spark, sf_dir):
    """A raster's positive pixels as a sparse series and back, with their ranks."""
    from radarframe.operators import masks
    from radarframe.plans.pixels import pixels

    p = pixels(spark, sf_dir)
    mask = _written(masks.encoded(p, c("v") > 0))
    series = masks.sparse(p, mask, ["v"])
    return masks.ranked(masks.dense(series, mask, "v", 64), mask).select("row", "col", "rank", _R("v", 6).alias("v"))


@query(f"WITH {PAIR} SELECT row, col, round(r1 * r2 + i1 * i2, 6) AS re, round(i1 * r2 - r1 * i2, 6) AS im FROM pair")
def goldstein_unfiltered(spark, sf_dir):
    """The Goldstein filter with an exponent of zero: patches over all tiles blend to the interferogram that they were cut from."""
    from radarframe.operators import images, kernels

    done = kernels.goldstein_filter(images.crossed(pairs(spark, sf_dir)).select("row", "col", "re", "im"), 4, 3, 0.0, tile=64)
    return done.select("row", "col", _R("re", 6).alias("re"), _R("im", 6).alias("im"))


@query(f"WITH {PAIR} SELECT row // 64 AS id, CAST(least(64, max(row) - row // 64 * 64 + 1) AS BIGINT) AS lines, CAST(32 AS BIGINT) AS samples, count(*) * 2 AS values, round(sum(r1), 3) AS re, round(sum(i1), 3) AS im FROM pair GROUP BY 1")
def hdf5_datasets(spark, sf_dir):
    """The structure of files: each dataset's size, and sums over what it holds."""
    from radarframe.sources import hdf5 as h

    folder = _hdf5_files(spark, sf_dir)
    listed = h.datasets(spark, folder).select(F.regexp_extract("path", "([0-9]+)[.]h5$", 1).cast("long").alias("id"), c("shape")[0].alias("lines"), c("shape")[1].alias("samples"))
    whole = h.pixels(spark, folder, "science/swaths/HH").withColumn("id", F.regexp_extract("path", "([0-9]+)[.]h5$", 1).cast("long"))
    sums = whole.groupBy("id").agg((F.count("*") * 2).alias("values"), _R(F.sum("re"), 3).alias("re"), _R(F.sum("im"), 3).alias("im"))
    return listed.join(sums, "id")
