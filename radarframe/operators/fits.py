"""Polynomial surfaces fitted from sums, however many the points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _powers(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def surfaces(points: DataFrame, degree: int, by: list[str]) -> DataFrame:
    """(by..., x0, dx, y0, dy, c): least-squares polynomials of total degree ``degree`` for z over (x, y) scaled to [-1, 1].

    Coordinates are scaled by each group's own span, Spark sums the products of powers by group, and one small system a group is solved; directions
    that the points don't determine are left out. ``c`` is in the order of powers (0, 0), (0, 1), .. (1, 0), ..
    """
    whole = points.where(" and ".join(f"{k} is not null and not isnan({k})" for k in "xyz"))
    span = whole.groupBy(*by).agg(*(f(k).alias(f"{n}_{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in "xy"))
    met = whole.join(F.broadcast(span) if not by else span, by) if by else whole.crossJoin(F.broadcast(span))  # a row a group
    scaled = lambda k: F.when(F.col(f"hi_{k}") > F.col(f"lo_{k}"), 2 * (F.col(k) - F.col(f"lo_{k}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}")) - 1).otherwise(0.0)
    met = met.withColumns({"u": scaled("x"), "v": scaled("y")})
    power = lambda i, j: F.pow("u", F.lit(float(i))) * F.pow("v", F.lit(float(j)))
    moments = [F.sum(power(i, j)).alias(f"m_{i}_{j}") for i, j in _powers(2 * degree)]
    right = [F.sum(F.col("z") * power(i, j)).alias(f"r_{i}_{j}") for i, j in _powers(degree)]
    sums = met.groupBy(*by, "lo_x", "hi_x", "lo_y", "hi_y").agg(*moments, *right)
    kinds = dict(sums.dtypes)
    names = [*by, "x0", "dx", "y0", "dy", "c"]

    def solve(batches):
        import numpy as np
        import pandas as pd

        powers = _powers(degree)
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"m_{i + k}_{j + n}"] for k, n in powers] for i, j in powers], float)
                c = np.linalg.pinv(a, rcond=1e-13, hermitian=True) @ np.array([r[f"r_{i}_{j}"] for i, j in powers], float)
                rows.append([*(r[k] for k in by), r["lo_x"], r["hi_x"] - r["lo_x"], r["lo_y"], r["hi_y"] - r["lo_y"], c.tolist()])
            yield pd.DataFrame(rows, columns=names)

    own = "".join(f"{k} {kinds[k]}, " for k in by)
    return sums.mapInPandas(solve, f"{own}x0 double, dx double, y0 double, dy double, c array<double>")


def evaluated(points: DataFrame, fitted: DataFrame, degree: int, by: list[str]) -> DataFrame:
    """``points`` with ``fit``: the surface of their group at (x, y)."""
    met = points.join(F.broadcast(fitted) if not by else fitted, by) if by else points.crossJoin(F.broadcast(fitted))
    scaled = lambda k: F.when(F.col(f"d{k}") > 0, 2 * (F.col(k) - F.col(f"{k}0")) / F.col(f"d{k}") - 1).otherwise(0.0)
    terms = [F.get("c", F.lit(n)) * F.pow(scaled("x"), F.lit(float(i))) * F.pow(scaled("y"), F.lit(float(j))) for n, (i, j) in enumerate(_powers(degree))]
    return met.withColumn("fit", sum(terms[1:], terms[0])).drop("x0", "dx", "y0", "dy", "c")
