"""Smoothing splines over scattered scatterers, one surface a date.

The surface is a tensor of uniform cubic B-splines with a penalty on second differences. Only moments of the fit travel: a point
adds 16 x 16 products of its basis values, which Spark sums by date and cell, so no task holds a date's points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Intervals an axis, and the largest and smallest penalty tried.
INTERVALS, STIFF, LOOSE = 10, 1e12, 1e-12


def basis(x: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four B-splines at each x in [0, 1], and their values (n, 4)."""
    u = np.clip(np.asarray(x, float), 0, 1) * intervals
    k = np.minimum(u.astype(int), intervals - 1)
    t = u - k
    s = 1 - t
    return k, np.stack([s**3, 3 * t**3 - 6 * t**2 + 4, 3 * s**3 - 6 * s**2 + 4, t**3], 1) / 6


def moments(points: DataFrame, h: int, w: int, intervals: int = INTERVALS) -> DataFrame:
    """Sums (date, i, j, v) of weighted products of basis functions i and j; i = -1 stands for the values, and (-2, -2) counts the points.

    ``points`` (date, row, col, value, weight); rows with a null or NaN are left out.
    """
    size = intervals + 3

    def run(batches):
        for pdf in batches:
            pdf = pdf.dropna()
            for date, part in pdf.groupby("date", sort=False):
                (a, fa), (b, fb) = basis(part["row"].to_numpy() / max(h - 1, 1), intervals), basis(part["col"].to_numpy() / max(w - 1, 1), intervals)
                at = ((a[:, None, None] + np.arange(4)[None, :, None]) * size + b[:, None, None] + np.arange(4)[None, None, :]).reshape(len(part), 16)
                weight = part["weight"].to_numpy(float)
                f = (fa[:, :, None] * fb[:, None, :]).reshape(len(part), 16) * weight[:, None]
                z = part["value"].to_numpy(float) * weight
                i, j = np.repeat(at, 16, axis=1).ravel(), np.tile(at, (1, 16)).ravel()
                keys, where = np.unique(i * size * size + j, return_inverse=True)
                squares = np.bincount(where, (f[:, :, None] * f[:, None, :]).ravel())
                seen, back = np.unique(at.ravel(), return_inverse=True)
                against = np.bincount(back, (f * z[:, None]).ravel())
                yield pd.DataFrame({
                    "date": date, "i": np.concatenate([keys // (size * size), np.full(len(seen), -1), [-1, -2]]).astype("int32"),
                    "j": np.concatenate([keys % (size * size), seen, [-1, -2]]).astype("int32"), "v": np.concatenate([squares, against, [(z * z).sum(), len(part)]]),
                })

    kind = points.schema["date"].dataType.simpleString()
    parts = points.select("date", F.col("row").cast("double"), F.col("col").cast("double"), F.col("value").cast("double"), F.col("weight").cast("double")).mapInPandas(run, f"date {kind}, i int, j int, v double")
    return parts.groupBy("date", "i", "j").agg(F.sum("v").alias("v"))


def _penalty(size: int) -> np.ndarray:
    d = np.diff(np.eye(size), 2, axis=0)
    return np.kron(d.T @ d, np.eye(size)) + np.kron(np.eye(size), d.T @ d)


def fitted(points: DataFrame, h: int, w: int, intervals: int = INTERVALS, smoothing: float | None = None) -> DataFrame:
    """(date, coefficients, misfit): the smoothest surface whose weighted squared misfit is at most ``smoothing`` (n - sqrt(2 n) of n points, if none is given).

    A surface that can't be that close is the closest one. A date without points has no row.
    """
    size = intervals + 3
    roughness = _penalty(size)

    def solve(pdf):
        a, b = np.zeros((size * size, size * size)), np.zeros(size * size)
        i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy()
        inner, right = i >= 0, (i == -1) & (j >= 0)
        a[i[inner], j[inner]] = v[inner]
        b[j[right]] = v[right]
        total, n = v[(i == -1) & (j == -1)][0], v[i == -2][0]
        limit = n - np.sqrt(2 * n) if smoothing is None else smoothing
        scale = max(np.trace(a) / len(a), 1e-300)

        def at(strength):
            c = np.linalg.lstsq(a + strength * scale * roughness, b, rcond=1e-14)[0]
            return c, float(max(total - 2 * c @ b + c @ a @ c, 0.0))

        low, high = np.log(LOOSE), np.log(STIFF)
        best, misfit = at(STIFF)
        if misfit > limit:
            best, misfit = at(LOOSE)
            if misfit <= limit:
                for _ in range(30):
                    mid = (low + high) / 2
                    c, m = at(np.exp(mid))
                    if m <= limit:
                        low, best, misfit = mid, c, m
                    else:
                        high = mid
        return pd.DataFrame({"date": [pdf["date"].iloc[0]], "coefficients": [best.tolist()], "misfit": [misfit]})

    kind = points.schema["date"].dataType.simpleString()
    return moments(points, h, w, intervals).groupBy("date").applyInPandas(solve, f"date {kind}, coefficients array<double>, misfit double")


def evaluated(fits: DataFrame, h: int, w: int, intervals: int = INTERVALS) -> DataFrame:
    """(date, row, col, value): every pixel of the raster, a row of it at a time."""
    size = intervals + 3
    k, f = basis(np.arange(w) / max(w - 1, 1), intervals)

    def run(batches):
        for pdf in batches:
            for date, row, c in zip(pdf["date"], pdf["row"], pdf["coefficients"], strict=True):
                a, fa = basis(np.array([row / max(h - 1, 1)]), intervals)
                line = fa[0] @ np.asarray(c).reshape(size, size)[a[0] : a[0] + 4]
                yield pd.DataFrame({"date": date, "row": row, "col": np.arange(w), "value": (line[k[:, None] + np.arange(4)] * f).sum(1)})

    kind = fits.schema["date"].dataType.simpleString()
    lines = fits.select("date", "coefficients", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("row")).repartition("date", "row")
    return lines.mapInPandas(run, f"date {kind}, row int, col int, value double")


def atmosphere(points: DataFrame, planes: DataFrame, h: int, w: int, intervals: int = INTERVALS) -> DataFrame:
    """The spline of residuals plus each date's constant and plane (date, a, by_row, by_col); a date without residuals has its plane alone."""
    kind = planes.schema["date"].dataType.simpleString()
    fits = planes.join(fitted(points, h, w, intervals).select(F.col("date").cast(kind), "coefficients"), "date", "left")
    fits = fits.withColumn("coefficients", F.coalesce("coefficients", F.array_repeat(F.lit(0.0), (intervals + 3) ** 2)))
    full = evaluated(fits, h, w, intervals).join(planes, "date")
    return full.select("date", "row", "col", (F.col("value") + F.col("a") + F.col("by_row") * F.col("row") + F.col("by_col") * F.col("col")).alias("value"))
