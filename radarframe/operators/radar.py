"""Terrain seen by the radar: height models coded into image geometry, and simulated backscatter.

A height model is a table (row, col, x, y, z) of grid nodes in earth-centred metres. Its nodes are projected
where they lie, cells are formed by windows along rows and columns, and what reaches one pixel is summed by
one aggregate, with partial sums before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import geometry, raster


def image_nodes(dem: DataFrame, orbit: geometry.Orbit, first_azt: float, azimuth_frequency: float, first_rng: float, range_step: float) -> DataFrame:
    """dem with line and sample (both real), incidence, unit look vector and angle off nadir of each node."""
    keyed = dem.select(F.struct(*dem.columns).alias("id"), "x", "y", "z")  # a node's columns go with it, so that none is joined back
    seen = geometry.project_with_look(keyed, orbit).where("converged")
    return seen.select(*(F.col("id")[k].alias(k) for k in dem.columns), ((F.col("azt") - first_azt) * azimuth_frequency).alias("line"), ((F.col("rng") - first_rng) / range_step).alias("sample"), "incidence", "lx", "ly", "lz", "off")


def cells(nodes: DataFrame, values: list[str]) -> DataFrame:
    """row, col, corners p0 (here), p1 (right), p2 (below), p3 (both): structs of ``values``. Cells without all corners are left out."""
    df = nodes.select("row", "col", F.struct(*values).alias("p0"))
    df = df.withColumn("p1", F.lead("p0").over(raster.along("col", "row")))
    w = raster.along("row", "col")
    return df.withColumn("p2", F.lead("p0").over(w)).withColumn("p3", F.lead("p1").over(w)).where("p1 is not null and p2 is not null and p3 is not null")


def triangles(nodes: DataFrame, values: list[str]) -> DataFrame:
    """row, col, a, b, c of the two triangles of each cell."""
    halves = F.explode(F.array(*(F.struct(*(F.col(p).alias(k) for p, k in zip(t, "abc", strict=True))) for t in (("p0", "p1", "p2"), ("p3", "p2", "p1")))))
    return cells(nodes, values).select("row", "col", halves.alias("t")).select("row", "col", "t.*")


def radarcoded(nodes: DataFrame, value: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """line, sample, value on whole pixels of a width x height image: linear within the triangle over a pixel, the mean where several lie over it. Without a size the image reaches as far as the nodes.

    ``nodes`` has line, sample and the value. A triangle is exploded to the pixels of its bounding box, so a
    grid about as fine as the image gives few pixels each.
    """
    t = triangles(nodes, ["line", "sample", value])
    lines, samples = ([F.col(f"{k}.{axis}") for k in "abc"] for axis in ("line", "sample"))

    def span(v: list[Column], top: int | None) -> Column:
        low, high = F.greatest(F.ceil(F.least(*v)), F.lit(0)).cast("long"), F.floor(F.greatest(*v)).cast("long")
        high = high if top is None else F.least(high, F.lit(top - 1).cast("long"))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    t = t.withColumn("line", span(lines, height)).withColumn("sample", span(samples, width))
    (ya, yb, yc), (xa, xb, xc), y, x = lines, samples, F.col("line"), F.col("sample")
    area = (yb - ya) * (xc - xa) - (yc - ya) * (xb - xa)
    u = ((y - ya) * (xc - xa) - (yc - ya) * (x - xa)) / area
    v = ((yb - ya) * (x - xa) - (y - ya) * (xb - xa)) / area
    t = t.where(area != 0).withColumn("u", u).withColumn("v", v).where("u >= -1e-9 and v >= -1e-9 and u + v <= 1 + 1e-9")
    got = (1 - F.col("u") - F.col("v")) * F.col(f"a.{value}") + F.col("u") * F.col(f"b.{value}") + F.col("v") * F.col(f"c.{value}")
    return t.groupBy("line", "sample").agg(F.avg(got).alias(value))


def splatted(points: DataFrame, weight: str) -> DataFrame:
    """line, sample, weight: each point's weight dealt to the four pixels around it by distance."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    p = points.withColumn("l0", F.floor("line")).withColumn("s0", F.floor("sample")).withColumn("k", corner)
    fy, fx = F.col("line") - F.col("l0"), F.col("sample") - F.col("s0")
    part = F.col(weight) * F.when(F.col("k.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("k.j") == 1, fx).otherwise(1 - fx)
    return p.groupBy((F.col("l0") + F.col("k.i")).alias("line"), (F.col("s0") + F.col("k.j")).alias("sample")).agg(F.sum(part).alias(weight))


def simulated(dem: DataFrame, orbit: geometry.Orbit, first_azt: float, azimuth_frequency: float, first_rng: float, range_step: float, pixel_area: float, shadows: bool = True) -> DataFrame:
    """line, sample, area: the ground facing the sensor in each pixel, over a flat pixel's area.

    A facet counts by its area as projected on the plane normal to its line of sight. ``dem`` rows run away
    from the sensor's track by growing col; along them a node below the largest angle off nadir met before lies in shadow.
    """
    nodes = image_nodes(dem, orbit, first_azt, azimuth_frequency, first_rng, range_step)
    if shadows:
        # lit is told along whole rows; a facet needs all its nodes lit
        nodes = raster.shadow(nodes, "off")
    else:
        nodes = nodes.withColumn("lit", F.lit(True))
    t = triangles(nodes, ["x", "y", "z", "line", "sample", "lx", "ly", "lz", "lit"]).where("a.lit and b.lit and c.lit")
    look = [F.col(f"a.l{axis}") for axis in "xyz"]

    def flat_side(start: str, end: str) -> Column:
        d = [F.col(f"{end}.{axis}") - F.col(f"{start}.{axis}") for axis in "xyz"]
        along = phase.dot(d, look)
        return phase.norm([p - along * q for p, q in zip(d, look, strict=True)])

    t = t.withColumn("ab", flat_side("a", "b")).withColumn("bc", flat_side("b", "c")).withColumn("ca", flat_side("c", "a"))
    s = (F.col("ab") + F.col("bc") + F.col("ca")) / 2
    heron = F.sqrt(F.greatest(F.lit(0.0), s * (s - F.col("ab")) * (s - F.col("bc")) * (s - F.col("ca"))))
    mean = lambda axis: reduce(lambda q, r: q + r, [F.col(f"{k}.{axis}") for k in "abc"]) / 3
    return splatted(t.select(mean("line").alias("line"), mean("sample").alias("sample"), (heron / pixel_area).alias("area")), "area")
