"""Orthorectification: a height model in image coordinates becomes a map from ground cells to image positions, through which rasters are pulled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a cell's weights that has to be there for it to count; what is missing is rounding.
WHOLE = 1 - 1e-9


def sampled(raster: DataFrame, at: DataFrame, values: list[str], keep: list[str], by: list[str] = ()) -> DataFrame:
    """``at`` (keep..., y, x) with the values of raster (row, col, values...) interpolated bilinearly; null where a corner that counts is missing.

    ``by`` names those of the kept columns that tell several rasters apart.

    Corners without weight aren't looked up, so that places on the last row or column have a value. One equi-join on the pixel,
    one aggregation by place; a place without y or x keeps its row.
    """
    corner = F.explode_outer(F.filter(F.array(*(F.struct((F.floor("y") + i).alias("row"), (F.floor("x") + j).alias("col"), (_part("y", i) * _part("x", j)).alias("w")) for i in (0, 1) for j in (0, 1))), lambda p: p["w"] > 0))
    met = at.select(*keep, "y", "x", corner.alias("__c")).select(*keep, "y", "x", F.col("__c.row").alias("row"), F.col("__c.col").alias("col"), F.col("__c.w").alias("__w"))
    met = met.join(raster.select(*by, "row", "col", *values), [*by, "row", "col"], "left")
    there = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("__w")))
    return met.groupBy(*keep, "y", "x").agg(*(F.when(there(v) > WHOLE, F.sum(F.col("__w") * F.col(v))).alias(v) for v in values))


def _part(axis: str, upper: int) -> Column:
    f = F.col(axis) - F.floor(axis)
    return f if upper else 1 - f


def coordinate_map(nodes: DataFrame, grid: DataFrame, origin: tuple[float, float] = (0.0, 0.0), looks: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Cells of ``grid`` (row, col, y, x: their place among the height model's nodes) as (row, col, y, x) in the image, less the rectangle's corner.

    ``nodes`` (row, col, line, sample) is the projected height model; ``looks`` are those of a multilooked raster, by azimuth and range.
    """
    met = sampled(nodes, grid.withColumnsRenamed({"row": "__i", "col": "__j"}), ["line", "sample"], ["__i", "__j"])
    y, x = (F.col("line") - origin[0]) / looks[0], (F.col("sample") - origin[1]) / looks[1]
    return met.select(F.col("__i").alias("row"), F.col("__j").alias("col"), y.alias("y"), x.alias("x"))


def pulled(raster: DataFrame, mapped: DataFrame, values: list[str], nearest: bool = False) -> DataFrame:
    """The raster's values in the cells of a coordinate map; null where the image has none. Complex rasters give both parts as values."""
    if nearest:
        near = mapped.select(F.col("row").alias("__i"), F.col("col").alias("__j"), F.rint("y").cast("long").alias("row"), F.rint("x").cast("long").alias("col"))
        return near.join(raster.select("row", "col", *values), ["row", "col"], "left").select(F.col("__i").alias("row"), F.col("__j").alias("col"), *values)
    met = sampled(raster, mapped.withColumnsRenamed({"row": "__i", "col": "__j"}), values, ["__i", "__j"])
    return met.select(F.col("__i").alias("row"), F.col("__j").alias("col"), *values)


def aligned_grid(left: float, bottom: float, right: float, top: float, resolution: float, align: float | None = None) -> tuple[float, float, int, int]:
    """Left, top, width and height in cells of a grid around bounds, its corner on multiples of ``align`` (the resolution, if none is given; 0: as it is)."""
    if align and align % resolution:
        raise ValueError("the alignment has to be a multiple of the resolution")
    align = resolution if align is None else align
    if align > 0:
        down, up = (lambda v: align * (v // align)), (lambda v: -align * (-v // align))
        left, bottom, right, top = down(left), down(bottom), up(right), up(top)
    return left, top, int((right - left) / resolution), int((top - bottom) / resolution)
