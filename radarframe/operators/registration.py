"""Registration of images to a primary one: affine maps from ground points that both see, resampling, refinement on amplitudes, and mosaics of bursts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radarframe.operators import geometry, kernels, resampling

_AXES = ("col", "row", "to_col", "to_row")


def ground_sample(dem: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """A share of the height model's points that have a height; which ones depends on the seed and the point's place, not on partitions."""
    known = dem.where(F.col("alt").isNotNull() & ~F.isnan("alt"))
    return known if ratio >= 1 else known.where(F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 30)) < int(ratio * (1 << 30)))


def affines(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., matrix): total least squares maps from (col, row) to (to_col, to_row), as rows [a, b, c, d, e, f] of x' = a x + b y + c, y' = d x + e y + f.

    Spark sums means and products by group, however many the points; one row a group is solved. Fewer than three points, or points on a line, give a null.
    """
    whole = matches.where(" and ".join(f"{a} is not null and not isnan({a})" for a in _AXES))
    sums = [F.avg(a).alias(f"m_{a}") for a in _AXES] + [F.covar_pop(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(_AXES) for b in _AXES[i:]]
    moments = whole.groupBy(*by).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for one in pdf.to_dict("records"):
                s = np.array([[one[f"s_{_AXES[min(i, j)]}_{_AXES[max(i, j)]}"] for j in range(4)] for i in range(4)])
                v = np.linalg.eigh(s)[1][:, ::-1]
                low = v[2:, 2:].T
                if one["n"] < 3 or np.linalg.eigvalsh(s[:2, :2])[0] < 1e-9 or abs(np.linalg.det(low)) < 1e-12:
                    out.append(None)
                    continue
                a = -np.linalg.solve(low, v[:2, 2:].T)
                m = np.array([one[f"m_{x}"] for x in _AXES])
                c = m[2:] - a @ m[:2]
                out.append([*map(float, a[0]), float(c[0]), *map(float, a[1]), float(c[1])])
            yield pdf[by].assign(matrix=out)

    kept = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in by)
    return moments.mapInPandas(solve, f"{kept}, matrix array<double>")


def resampled(images: DataFrame, maps: DataFrame, by: list[str], values: list[str], rectangle: tuple[int, int, int, int], method: str = "lanczos", tile: int = 256) -> DataFrame:
    """Each image pulled into the primary's rectangle (col, row, w, h) through its map: (by..., row, col from the rectangle's corner, values...). An image without a map is null throughout.

    ``maps`` (by..., matrix) may bring a ``ramp`` (:data:`resampling.RAMP`), which is taken off around the interpolation."""
    col, row, w, h = rectangle
    named = maps.withColumn("rectangle", F.struct(*(F.lit(v).cast("int").alias(k) for k, v in zip(("col", "row", "w", "h"), rectangle, strict=True))))
    got = resampling.warped(images, named, by, values, method, tile=tile)
    return got.select(*by, (F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), *values)


def shifts(primary: DataFrame, secondaries: DataFrame, by: list[str], value: str = "amp", block: int = 2048, least: float = 0.0, most_second: float | None = None, max_shift: float | None = None) -> DataFrame:
    """(by..., d_col, d_row, peak) of each secondary against the primary by phase correlation, of the block whose peak is highest.

    A crop within one block is correlated as a whole; a task holds one block of one pair, whatever the image's size. Blocks whose peak is below ``least``, whose second peak
    is above ``most_second`` of it, or that are moved by ``max_shift`` or more don't count (:func:`kernels.guarded_shift`); a pair without any has nulls.
    """
    tile = [F.floor(F.col("row") / block).alias("__r"), F.floor(F.col("col") / block).alias("__c")]
    both = secondaries.select(*by, "row", "col", *tile, F.col(value).alias("b")).join(primary.select("row", "col", F.col(value).alias("a")), ["row", "col"])

    def one(pdf):
        r, c = pdf["row"].to_numpy() - pdf["row"].min(), pdf["col"].to_numpy() - pdf["col"].min()
        a, b = (np.zeros((r.max() + 1, c.max() + 1)) for _ in range(2))
        a[r, c], b[r, c] = np.nan_to_num(pdf["a"].to_numpy(float)), np.nan_to_num(pdf["b"].to_numpy(float))
        d_row, d_col, peak = kernels.guarded_shift(a, b, least, most_second, max_shift)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "d_col": [float(d_col)], "d_row": [float(d_row)], "peak": [float(peak)]})

    kept = ", ".join(f"{k} {secondaries.schema[k].dataType.simpleString()}" for k in by)
    found = both.groupBy(*by, "__r", "__c").applyInPandas(one, f"{kept}, d_col double, d_row double, peak double")
    sure = F.when(~F.isnan("peak"), F.struct("peak", "d_col", "d_row"))
    return found.groupBy(*by).agg(F.max(sure).alias("b")).select(*by, "b.d_col", "b.d_row", "b.peak")


def shifted(maps: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Maps followed by a translation in the secondary image; a map without one stays."""
    d_col, d_row = F.coalesce("d_col", F.lit(0.0)), F.coalesce("d_row", F.lit(0.0))
    added = F.transform("matrix", lambda v, k: v + F.when(k == 2, d_col).when(k == 5, d_row).otherwise(0.0))
    kept = [c for c in maps.columns if c not in by and c != "matrix"]
    return maps.join(moves, by, "left").select(*by, added.alias("matrix"), *kept)


def mosaic(pixels: DataFrame, parts: DataFrame, values: list[str]) -> DataFrame:
    """Burst pixels (acquisition, swath, burst, row, col from the burst's corner, values...) at their places in the rectangle that ``bursts.stitched`` cut ``parts`` for.

    Inner rectangles don't meet, so no pixel is written twice.
    """
    c = F.col
    met = pixels.join(parts.select("acquisition", "swath", "burst", "read", "write"), ["acquisition", "swath", "burst"])
    inside = (c("col") >= c("read.col")) & (c("col") < c("read.col") + c("read.w")) & (c("row") >= c("read.row")) & (c("row") < c("read.row") + c("read.h"))
    return met.where(inside).select("acquisition", (c("row") - c("read.row") + c("write.row")).alias("row"), (c("col") - c("read.col") + c("write.col")).alias("col"), *values)


def matches(dem: DataFrame, primary: geometry.Orbit, secondaries: dict[str, geometry.Orbit], timings: dict[str, tuple[float, float, float, float]], primary_id: str) -> DataFrame:
    """(product, col, row, to_col, to_row): places of the height model's points (row, col, x, y, z) in the primary and in each secondary.

    ``timings`` give by product its first time, lines a second, first range and metres a sample. Points are projected where they
    lie; the primary's places are joined to the others' by point.
    """
    points = dem.select(F.struct("row", "col").alias("id"), "x", "y", "z")

    def placed(orbit: geometry.Orbit, product: str, row: str, col: str) -> DataFrame:
        t0, frequency, r0, step = timings[product]
        p = geometry.project(points, orbit).where("converged")
        return p.select("id", ((F.col("azt") - t0) * frequency).alias(row), ((F.col("rng") - r0) / step).alias(col))

    first = placed(primary, primary_id, "row", "col")
    others = None
    for product, orbit in secondaries.items():
        one = placed(orbit, product, "to_row", "to_col").select(F.lit(product).alias("product"), "*")
        others = one if others is None else others.unionByName(one)
    return others.join(first, "id").select("product", "col", "row", "to_col", "to_row")


def crops(images: DataFrame, maps: DataFrame, primary_id: str, rectangle: tuple[int, int, int, int], checkpoint: Callable[[DataFrame], DataFrame] | None = None, block: int = 2048) -> DataFrame:
    """Crops (product, row, col, re, im) of a primary and its secondaries in the primary's rectangle.

    ``images`` (product, row, col, re, im) are whole images; ``maps`` (product, matrix, and ramp where there is one) take the primary to each secondary. With a
    ``checkpoint``, which keeps the first round's crops, the maps are refined by phase correlation on amplitudes, and the images are resampled again.
    """
    col, row, w, h = rectangle
    inside = F.col("row").between(row, row + h - 1) & F.col("col").between(col, col + w - 1)
    own = images.where((F.col("product") == primary_id) & inside).select("product", (F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "re", "im")
    others = images.where(F.col("product") != primary_id)
    if checkpoint is not None:
        amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        rough = checkpoint(resampled(others, maps, ["product"], ["re", "im"], rectangle))
        moves = shifts(own.withColumn("amp", amp), rough.withColumn("amp", amp), ["product"], block=block)
        maps = shifted(maps, moves, ["product"])
    return own.unionByName(resampled(others, maps, ["product"], ["re", "im"], rectangle))
