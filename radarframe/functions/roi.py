"""Rectangles (col, row, w, h) of whole pixels, tiles, pixel grids and affine maps between pixels and the ground.

Bounds are inclusive: a rectangle's last column is ``col + w - 1``. An affine map is (a, b, c, d, e, f):
x = a col + b row + c, y = d col + e row + f.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def roi(col, row, w, h) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, (int, float)) else v).cast("long").alias(k) for k, v in (("col", col), ("row", row), ("w", w), ("h", h))))


def contains(r: Column, col: Column, row: Column) -> Column:
    return col.between(r["col"], r["col"] + r["w"] - 1) & row.between(r["row"], r["row"] + r["h"] - 1)


def with_margin(r: Column, left: int, top: int, right: int | None = None, bottom: int | None = None) -> Column:
    """The rectangle with pixels added (or, if negative, taken away) on its sides."""
    right, bottom = left if right is None else right, top if bottom is None else bottom
    return roi(r["col"] - left, r["row"] - top, r["w"] + left + right, r["h"] + top + bottom)


def translated(r: Column, cols: int, rows: int) -> Column:
    return roi(r["col"] + cols, r["row"] + rows, r["w"], r["h"])


def made_valid(r: Column, width: int, height: int) -> Column:
    """The rectangle's part on an image of this size; (0, 0, 0, 0) where there is none."""
    c0, r0 = F.greatest(r["col"], F.lit(0)), F.greatest(r["row"], F.lit(0))
    w, h = F.least(r["col"] + r["w"], F.lit(width)) - c0, F.least(r["row"] + r["h"], F.lit(height)) - r0
    some = (w > 0) & (h > 0)
    return roi(*(F.when(some, v).otherwise(0) for v in (c0, r0, w, h)))


def _around(xs: list[Column], ys: list[Column]) -> Column:
    c0, r0 = F.floor(F.least(*xs)), F.floor(F.least(*ys))
    return roi(c0, r0, F.ceil(F.greatest(*xs)) - c0 + 1, F.ceil(F.greatest(*ys)) - r0 + 1)


def warped(r: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """The smallest rectangle of whole pixels around the mapped corners."""
    cols, rows = (r["col"], r["col"] + r["w"] - 1), (r["row"], r["row"] + r["h"] - 1)
    corners = [(x, y) for x in cols for y in rows]
    return _around([a * x + b * y + c for x, y in corners], [d * x + e * y + f for x, y in corners])


def enlarged(r: Column, least_w: int, least_h: int) -> Column:
    """A rectangle of this size at least about the same centre; halves are cut off towards zero."""
    w, h = F.greatest(r["w"], F.lit(least_w)), F.greatest(r["h"], F.lit(least_h))
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return roi(cut(r["col"] + r["w"] / 2 - w / 2), cut(r["row"] + r["h"] / 2 - h / 2), w, h)


def bounding(points: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """row0, row1, col0, col1: whole bounds of the points, in all or of each group."""
    return points.groupBy(*by).agg(F.floor(F.min(y)).alias("row0"), F.ceil(F.max(y)).alias("row1"), F.floor(F.min(x)).alias("col0"), F.ceil(F.max(x)).alias("col1"))


def of_geometry(points: DataFrame, by: list[str], least_w: int = 1024, least_h: int = 512) -> DataFrame:
    """(by..., roi): the rectangle around the projected points (x, y) of an area, enlarged to a least size about its centre."""
    b = bounding(points, "x", "y", by)
    return b.select(*by, enlarged(roi(F.col("col0"), F.col("row0"), F.col("col1") - F.col("col0") + 1, F.col("row1") - F.col("row0") + 1), least_w, least_h).alias("roi"))


def about_centre(x: Column, y: Column, w: int, h: int) -> Column:
    """A rectangle of this size about a projected point."""
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    return roi(cut(x - w / 2), cut(y - h / 2), w, h)


def on_ground(col: Column, row: Column, transform: tuple[float, ...], area: bool = True) -> tuple[Column, Column]:
    """x, y of pixel centres; where a pixel is an area, its centre is half a pixel from its corner."""
    a, b, c, d, e, f = transform
    half = 0.5 if area else 0.0
    return a * (col + half) + b * (row + half) + c, d * (col + half) + e * (row + half) + f


def in_raster(x: Column, y: Column, transform: tuple[float, ...], area: bool = True) -> tuple[Column, Column]:
    """col, row (fractional) of ground points: the inverse of :func:`on_ground`."""
    a, b, c, d, e, f = transform
    det = a * e - b * d
    if det == 0:
        raise ValueError("the map has no inverse")
    half = 0.5 if area else 0.0
    return (e * (x - c) - b * (y - f)) / det - half, (a * (y - f) - d * (x - c)) / det - half


def raster_roi(points: DataFrame, by: list[str], transform: tuple[float, ...], width: int, height: int, area: bool = True) -> DataFrame:
    """(by..., roi): the part of a raster that holds the ground points (x, y) of each geometry."""
    col, row = in_raster(F.col("x"), F.col("y"), transform, area)
    b = bounding(points.withColumns({"__col": col, "__row": row}), "__col", "__row", by)
    return b.select(*by, made_valid(roi(F.col("col0"), F.col("row0"), F.col("col1") - F.col("col0") + 1, F.col("row1") - F.col("row0") + 1), width, height).alias("roi"))


def pixel_grid(spark: SparkSession, rows: int, cols: int, transform: tuple[float, ...] | None = None, area: bool = True) -> DataFrame:
    """row, col and, with a map, x, y of each pixel's centre; lines are dealt to tasks."""
    g = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    if transform is None:
        return g
    x, y = on_ground(F.col("col"), F.col("row"), transform, area)
    return g.select("row", "col", x.alias("x"), y.alias("y"))


def pixel_grids(rasters: DataFrame, by: list[str], area: bool = True) -> DataFrame:
    """by..., row, col, x, y of the centres of each raster's pixels; ``rasters`` (by..., h, w, transform) have a row each, whose lines are dealt to tasks."""
    lines = rasters.where("h > 0 and w > 0").select(*by, "w", "transform", F.explode(F.expr("sequence(0L, cast(h as bigint) - 1)")).alias("row"))
    cells = lines.select(*by, "transform", "row", F.explode(F.expr("sequence(0L, cast(w as bigint) - 1)")).alias("col"))
    x, y = on_ground(F.col("col"), F.col("row"), tuple(F.get("transform", F.lit(k)) for k in range(6)), area)
    return cells.select(*by, "row", "col", x.alias("x"), y.alias("y"))


def tiles(rects: DataFrame, w: str, h: str, tile_w: int, tile_h: int) -> DataFrame:
    """``rects`` with col, row, tile_w, tile_h of each tile, line by line, cut at the far sides."""
    starts = lambda n, s: F.explode(F.expr(f"sequence(0L, cast(({n} - 1) div {s} as long))"))
    r = rects.where((F.col(w) > 0) & (F.col(h) > 0)).withColumn("__i", starts(w, tile_w)).withColumn("__j", starts(h, tile_h))
    return r.select(
        *rects.columns, (F.col("__i") * tile_w).alias("col"), (F.col("__j") * tile_h).alias("row"),
        F.least(F.lit(tile_w), F.col(w) - F.col("__i") * tile_w).alias("tile_w"), F.least(F.lit(tile_h), F.col(h) - F.col("__j") * tile_h).alias("tile_h"),
    )


def ring_place(row: Column, col: Column, centre: tuple[int, int], guard: int, search: int) -> Column:
    """``guard``, ``ring`` or ``outside``: where a pixel lies about a centre."""
    d = F.greatest(F.abs(row - centre[0]), F.abs(col - centre[1]))
    return F.when(d <= guard, "guard").when(d <= search, "ring").otherwise("outside")


def gathered(array: Column, ids: Column) -> Column:
    """The elements of an array at ``ids``, from 0; null where there is none."""
    return F.transform(ids, lambda i: F.get(array, i))


def block_factor(row: Column, col: Column, blocks: list[tuple]) -> Column:
    """1, or in the first of the blocks (row0, row1, col0, col1, first, last) that hold the pixel a factor linear in the line.

    The factor is ``first`` at row0 and ``last`` at row1. A block ends before row1, or where a seventh element says, which is None for a block without an end: there the factor goes on in line.
    """
    out = F.lit(1.0)
    for r0, r1, c0, c1, first, last, *end in reversed(blocks):
        end = end[0] if end else r1
        lines = row >= r0 if end is None else row.between(r0, end - 1)
        out = F.when(lines & col.between(c0, c1 - 1), first + (last - first) * (row - r0) / (r1 - r0)).otherwise(out)
    return out


# 3 x 3 maps of (row, col, 1), on the driver


def times(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]


def translation(rows: float, cols: float) -> list[list[float]]:
    return [[1.0, 0.0, float(rows)], [0.0, 1.0, float(cols)], [0.0, 0.0, 1.0]]


def moved_origins(matrix: list[list[float]], row_dst: float, col_dst: float, row_src: float, col_src: float) -> list[list[float]]:
    """A map from destination to source pixels, for pixels counted from new origins in either image."""
    return times(translation(-row_src, -col_src), times(matrix, translation(row_dst, col_dst)))


def zoomed(rows: float, cols: float) -> list[list[float]]:
    """The map from the pixels of an image enlarged by these factors to its own."""
    return [[1.0 / rows, 0.0, 0.0], [0.0, 1.0 / cols, 0.0], [0.0, 0.0, 1.0]]


def zoomed_roi(r: Column, rows: int, cols: int) -> Column:
    """The rectangle in an enlarged image."""
    return roi(r["col"] * cols, r["row"] * rows, r["w"] * cols, r["h"] * rows)
