"""Neighbourhood operators on long pixel tables (row, col, value).

Windows run along one axis at a time, so a task holds one row or column of a raster, not the raster;
``by`` names further partition columns, such as an image or tile id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(axis: str, other: str, by: list[str] = ()) -> Window:
    return Window.partitionBy(*by, other).orderBy(axis)


def box_mean(df: DataFrame, values: list[str], half_rows: int, half_cols: int, by: list[str] = ()) -> DataFrame:
    """Moving means over (2 half_rows + 1) x (2 half_cols + 1) pixels; at edges, over the pixels there are.

    Sums and counts are separable and go first along columns, then along rows.
    """
    w = along("col", "row", by).rangeBetween(-half_cols, half_cols)
    df = df.select("*", *(F.sum(v).over(w).alias(f"__s_{v}") for v in values), *(F.count(v).over(w).alias(f"__n_{v}") for v in values))
    w = along("row", "col", by).rangeBetween(-half_rows, half_rows)
    df = df.select("*", *((F.sum(f"__s_{v}").over(w) / F.sum(f"__n_{v}").over(w)).alias(f"mean_{v}") for v in values))
    return df.drop(*(f"__{k}_{v}" for k in "sn" for v in values))


def local_extreme(df: DataFrame, value: str, out: str, largest: bool = False, by: list[str] = ()) -> DataFrame:
    """Extreme of each pixel's 3 x 3 neighbourhood."""
    pick = F.max if largest else F.min
    df = df.withColumn("__e", pick(value).over(along("col", "row", by).rangeBetween(-1, 1)))
    return df.withColumn(out, pick("__e").over(along("row", "col", by).rangeBetween(-1, 1))).drop("__e")


def residues(df: DataFrame, wrap, by: list[str] = ()) -> DataFrame:
    """df (row, col, phi) with the wrapped gradients and the integer residue of each 2 x 2 loop."""
    right, down = along("col", "row", by), along("row", "col", by)
    df = df.withColumn("gx", wrap(F.lead("phi").over(right) - F.col("phi"))).withColumn("gy", wrap(F.lead("phi").over(down) - F.col("phi")))
    df = df.withColumn("gx_below", F.lead("gx").over(down)).withColumn("gy_right", F.lead("gy").over(right))
    turn = F.col("gx") + F.col("gy_right") - F.col("gx_below") - F.col("gy")
    return df.withColumn("residue", F.rint(turn / (-2 * F.pi())).cast("int")).drop("gx_below", "gy_right")


def integrated(df: DataFrame, wrap, by: list[str] = ()) -> DataFrame:
    """Unwrapped phase by path: down the first column, then along each row. Exact where there are no residues."""
    step = wrap(F.col("phi") - F.lag("phi").over(along("col", "row", by)))
    df = df.withColumn("__dx", F.coalesce(step, F.lit(0.0))).withColumn("__x", F.sum("__dx").over(along("col", "row", by)))
    first = df.where("col = 0").select(*by, "row", F.col("phi").alias("__phi0"))
    whole = Window.partitionBy(*by).orderBy("row")  # one pixel a row of the raster
    first = first.withColumn("__dy", F.coalesce(wrap(F.col("__phi0") - F.lag("__phi0").over(whole)), F.lit(0.0)))
    first = first.withColumn("__y", F.sum("__dy").over(whole) + F.first("__phi0").over(whole)).drop("__phi0", "__dy")
    return df.join(first, [*by, "row"]).withColumn("unwrapped", F.col("__x") + F.col("__y")).drop("__dx", "__x", "__y")


def border_mask(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``inside``: not left of its row's nor above its column's first valid pixel."""
    valid = F.when(F.col(value) > 0, F.lit(1))
    row = F.min(F.when(valid == 1, F.col("col"))).over(Window.partitionBy(*by, "row"))
    col = F.min(F.when(valid == 1, F.col("row"))).over(Window.partitionBy(*by, "col"))
    return df.withColumn("inside", F.coalesce((F.col("col") >= row) & (F.col("row") >= col), F.lit(False)))


def shadow(df: DataFrame, elevation: str, by: list[str] = ()) -> DataFrame:
    """``lit``: elevation angle not below the largest met before along the line."""
    w = along("col", "row", by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("lit", F.col(elevation) >= F.max(elevation).over(w))


def bilinear(df: DataFrame, points: DataFrame, value: str, how: str = "inner") -> DataFrame:
    """``points`` (id, y, x) with the value interpolated in df (row, col, value): four equi-joins, as one on exploded corners.

    ``corners`` counts the known ones; with ``how`` "left" points without any stay, with none."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    at = points.select("*", F.floor("y").alias("y0"), F.floor("x").alias("x0")).select("*", corner.alias("c"))
    fy, fx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    weight = F.when(F.col("c.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("c.j") == 1, fx).otherwise(1 - fx)
    met = at.select("id", "y", "x", (F.col("y0") + F.col("c.i")).alias("row"), (F.col("x0") + F.col("c.j")).alias("col"), weight.alias("w")).join(df, ["row", "col"], how)
    return met.groupBy("id", "y", "x").agg(F.sum(F.col("w") * F.col(value)).alias("value"), F.count("*" if how == "inner" else value).alias("corners"))




def interpolated(table: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (id, t) with the value of the piecewise linear ``table`` (x, v), constant beyond its ends. Zeros of the table are left out.

    A lookup table is an axis of an image, some thousand nodes, and is folded into one row.
    """
    nodes = table.where("v <> 0").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("nodes"))
    met = points.crossJoin(F.broadcast(nodes)).withColumn("k", F.expr("size(filter(nodes, n -> n.x <= t))"))
    a, b = F.get("nodes", F.col("k") - 1), F.get("nodes", F.col("k"))
    value = F.when(F.col("k") == 0, b["v"]).when(F.col("k") >= F.size("nodes"), a["v"]).otherwise(a["v"] + (F.col("t") - a["x"]) / (b["x"] - a["x"]) * (b["v"] - a["v"]))
    return met.select("id", "t", value.alias("value"))


def _ends(source: str, w: Window) -> tuple[Column, Column]:
    """First and last value of a line or column. Both are of the whole of it, so they are told once: a frame that ends later than its row but begins with it is summed anew for each row."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(source).over(whole), F.last(source).over(whole)


def weighted(df: DataFrame, value: str, weights: list[float], by: list[str] = ()) -> DataFrame:
    """``smooth``: a separable filter of odd length along both axes; an edge pixel stands for those beyond it."""
    half = len(weights) // 2

    def one(source: str, w: Window) -> Column:
        ends = _ends(source, w)
        terms = [F.coalesce(F.lag(source, -k).over(w), ends[k > 0]) if k else F.col(source) for k in range(-half, half + 1)]
        return sum((x * t for x, t in zip(weights, terms, strict=True)), F.lit(0.0))

    df = df.withColumn("__h", one(value, along("col", "row", by)))
    return df.withColumn("smooth", one("__h", along("row", "col", by))).drop("__h")


def weighted_box(df: DataFrame, values: list[str], half_rows: int, half_cols: int, by: list[str] = ()) -> DataFrame:
    """``mean_...`` of each value: moving means in which an edge pixel stands for those beyond it, sizes differing by axis. All values go through the two windows together."""

    def one(source: str, half: int, w: Window) -> Column:
        ends = _ends(source, w)
        terms = [F.coalesce(F.lag(source, -k).over(w), ends[k > 0]) if k else F.col(source) for k in range(-half, half + 1)]
        return sum(terms[1:], terms[0]) / len(terms)

    df = df.select("*", *(one(v, half_cols, along("col", "row", by)).alias(f"__b_{v}") for v in values))
    df = df.select("*", *(one(f"__b_{v}", half_rows, along("row", "col", by)).alias(f"mean_{v}") for v in values))
    return df.drop(*(f"__b_{v}" for v in values))


def gaussian_weights(size: int) -> list[float]:
    """Of deviation size / 3, cut at four deviations."""
    sigma = size / 3
    half = int(4 * sigma + 0.5)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [r / sum(raw) for r in raw]


def quadric_peaks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """row, col, y, x of pixels that are the first largest of their 3 x 3 neighbourhood, with the top of the least-squares quadric.

    Border pixels have no whole neighbourhood; where the quadric has no maximum there is no row.
    """
    w = along("col", "row", by)
    df = df.select(*by, "row", "col", F.struct(F.lag(value).over(w).alias("l"), F.col(value).alias("m"), F.lead(value).over(w).alias("r")).alias("mid"))
    w = along("row", "col", by)
    df = df.withColumn("top", F.lag("mid").over(w)).withColumn("low", F.lead("mid").over(w))
    z = [F.col(f"{r}.{k}") for r in ("top", "mid", "low") for k in "lmr"]
    for n, x in enumerate(z):
        df = df.withColumn(f"z{n}", x)
    z = [F.col(f"z{n}") for n in range(9)]
    whole = df.where(" and ".join(f"z{n} is not null" for n in range(9))).where((z[4] > F.greatest(*z[:4])) & (z[4] >= F.greatest(*z[5:])))
    left, right, up, down = z[0] + z[3] + z[6], z[2] + z[5] + z[8], z[0] + z[1] + z[2], z[6] + z[7] + z[8]
    gx, gy = (right - left) / 6, (down - up) / 6
    a, b, k = (right + left - 2 * (z[1] + z[4] + z[7])) / 6, (down + up - 2 * (z[3] + z[4] + z[5])) / 6, (z[8] + z[0] - z[2] - z[6]) / 4
    det = 4 * a * b - k * k
    return whole.where((a < 0) & (det > 1e-6)).select(*by, "row", "col", (F.col("row") + (k * gx - 2 * a * gy) / det).alias("y"), (F.col("col") + (k * gy - 2 * b * gx) / det).alias("x"))
