"""Height models as tables: nodes (row, col, alt) of grids regular in longitude and latitude, fetched, stitched and sampled by joins.

A grid is (west, north, step): its node (row, col) lies at longitude west + col * step and latitude north - row * step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import geometry, raster


@dataclass(frozen=True)
class Grid:
    west: float
    north: float
    step: float

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """row and col (fractional) of a point."""
        return (self.north - lat) / self.step, (lon - self.west) / self.step

    def rows_cols(self, west: float, south: float, east: float, north: float, pad: float = 0.5) -> tuple[int, int, int, int]:
        """First and last row and column of the nodes needed to interpolate within bounds, with ``pad`` nodes around them."""
        import math

        first = lambda x: math.floor(x - pad)
        last = lambda x: math.ceil(x + pad)
        return first((self.north - north) / self.step), last((self.north - south) / self.step), first((west - self.west) / self.step), last((east - self.west) / self.step)


def fetched(nodes: DataFrame, grid: Grid, west: float, south: float, east: float, north: float) -> DataFrame:
    """The nodes around some bounds; the filter is on plain columns and reaches the scan."""
    r0, r1, c0, c1 = grid.rows_cols(west, south, east, north)
    return nodes.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def stitched(sources: list[DataFrame]) -> DataFrame:
    """One model of several on the same grid: of each node the first source that knows its height."""
    every = None
    for k, s in enumerate(sources):
        own = s.where(F.col("alt").isNotNull() & ~F.isnan("alt")).select("row", "col", F.struct(F.lit(k).alias("k"), "alt").alias("s"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("row", "col").agg(F.min("s").alias("s")).select("row", "col", "s.alt")


def sampled(nodes: DataFrame, grid: Grid, points: DataFrame, value: str = "alt", out: str = "alt") -> DataFrame:
    """``points`` (id, lon, lat) with ``out``: the height between the four nodes around each; null where one is missing."""
    y, x = grid.place(F.col("lon"), F.col("lat"))
    at = points.select(F.struct(*points.columns).alias("id"), y.alias("y"), x.alias("x"))
    known = nodes.where(F.col(value).isNotNull() & ~F.isnan(value)).select("row", "col", F.col(value).alias("__v"))
    got = raster.bilinear(known, at, "__v", "left")
    return got.select("id.*", F.when(F.col("corners") == 4, F.col("value")).alias(out))


def ellipsoidal(nodes: DataFrame, grid: Grid, geoid: DataFrame, geoid_grid: Grid) -> DataFrame:
    """Heights over the ellipsoid: those over the sea plus the geoid's, which is interpolated in its own, coarser grid."""
    at = nodes.select(F.struct("row", "col").alias("id"), "alt", (grid.west + F.col("col") * grid.step).alias("lon"), (grid.north - F.col("row") * grid.step).alias("lat"))
    done = sampled(geoid, geoid_grid, at, "undulation", "undulation")
    return done.select("id.row", "id.col", (F.col("alt") + F.col("undulation")).alias("alt"))


def localized(points: DataFrame, orbit: geometry.Orbit, nodes: DataFrame, grid: Grid, start: float = 0.0, rounds: int = 4, right: bool = True) -> DataFrame:
    """``points`` (id, azt, rng) on the model: x, y, z, lon, lat, alt and ``gap``, by how much the last round moved the height.

    Each round localises at the heights of the last, then looks up the model there; off the model the height stays and the gap is null.
    """
    at = points.select("id", "azt", "rng", F.lit(float(start)).alias("alt"))
    for _ in range(rounds):
        own = F.struct("id", "azt", "rng", "alt").alias("id")
        found = geometry.localize(at.select(own, "azt", "rng", "alt"), orbit, right)
        g = phase.geodetic(F.col("x"), F.col("y"), F.col("z"))
        found = found.select("id", "x", "y", "z", g["lon"].alias("lon"), g["lat"].alias("lat"))
        at = sampled(nodes, grid, found.select("id.*", "x", "y", "z", "lon", "lat"), "alt", "__alt").select("id", "azt", "rng", F.coalesce("__alt", "alt").alias("alt"), "x", "y", "z", "lon", "lat", F.abs(F.col("__alt") - F.col("alt")).alias("gap"))
    return at


def control_points(rectangles: DataFrame, orbit: geometry.Orbit, nodes: DataFrame, grid: Grid, n: int = 10, **how) -> DataFrame:
    """An n x n grid of image points over each rectangle (id, azt0, azt1, rng0, rng1) of azimuth times and ranges, on the model: id is a struct of the rectangle's and k, line by line."""
    g = rectangles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    share = lambda k, a, b: F.col(a) + k * ((F.col(b) - F.col(a)) / max(1, n - 1))
    at = g.select(F.struct("id", "k").alias("id"), share(F.expr(f"k div {n}"), "azt0", "azt1").alias("azt"), share(F.col("k") % n, "rng0", "rng1").alias("rng"))
    return localized(at, orbit, nodes, grid, **how)
