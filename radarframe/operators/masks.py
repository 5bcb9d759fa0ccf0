"""Masks as run-length bitmaps with ranks, so that sparse series and dense rasters turn into each other by offsets.

A mask is a row a raster line that has any of its pixels: the line's runs (first and last column, pixels before the run in the line), the line's
pixels ``n`` and those of the lines above, ``before``. A pixel's rank is its place among all pixels of the mask, line by line. Ranks of pixels and pixels of
ranks are then expressions on the line's row, met by an equi-join with a row a line; a whole line's values turn from sparse to dense without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks that share a bucket when pixels of ranks are looked up.
BUCKET = 4096


def encoded(pixels: DataFrame, inside: Column, by: list[str] = ()) -> DataFrame:
    """by..., row, runs: array<struct<c0, c1, rank>>, n, before of the pixels (by..., row, col) where ``inside`` holds; repeated pixels count once."""
    by = list(by)
    own = pixels.where(inside).select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    line = Window.partitionBy(*by, "row").orderBy("col")
    place = F.row_number().over(line) - 1
    # the pixels of a run are as far from their places
    runs = own.withColumn("__k", place.cast("long")).groupBy(*by, "row", (F.col("col") - F.col("__k")).alias("__g")).agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("__k").alias("rank"))
    lines = runs.groupBy(*by, "row").agg(F.sort_array(F.collect_list(F.struct("c0", "c1", "rank"))).alias("runs"), F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    above = Window.partitionBy(*by).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)  # a row a line
    return lines.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))


def rank_in(runs: Column, before: Column, col: Column) -> Column:
    """The rank of a column's pixel in its line; null where the mask doesn't have it."""
    hit = F.get(F.filter(runs, lambda r: (r["c0"] <= col) & (col <= r["c1"])), F.lit(0))
    return before + hit["rank"] + (col - hit["c0"])


def col_in(runs: Column, before: Column, rank: Column) -> Column:
    """The column of a rank's pixel in its line; null where it lies in another."""
    at = rank - before
    hit = F.get(F.filter(runs, lambda r: (r["rank"] <= at) & (at <= r["rank"] + r["c1"] - r["c0"])), F.lit(0))
    return hit["c0"] + (at - hit["rank"])


def ranked(pixels: DataFrame, mask: DataFrame, by: list[str] = ()) -> DataFrame:
    """``pixels`` (by..., row, col, ...) with ``rank``, null outside the mask."""
    met = pixels.join(mask, [*by, "row"], "left")
    return met.select(*pixels.columns, rank_in(F.col("runs"), F.col("before"), F.col("col")).alias("rank"))


def placed(ranks: DataFrame, mask: DataFrame, by: list[str] = ()) -> DataFrame:
    """``ranks`` (by..., rank, ...) with row and col; those beyond the mask are left out. Lines are listed by the buckets of their ranks, so both sides meet by an equi-join."""
    lines = mask.withColumn("__b", F.explode(F.sequence(F.floor(F.col("before") / BUCKET), F.floor((F.col("before") + F.col("n") - 1) / BUCKET))))
    met = ranks.withColumn("__b", F.floor(F.col("rank") / BUCKET)).join(lines, [*by, "__b"]).where("before <= rank and rank < before + n")
    return met.select(*ranks.columns, "row", col_in(F.col("runs"), F.col("before"), F.col("rank")).alias("col"))


def sparse(pixels: DataFrame, mask: DataFrame, values: list[str], by: list[str] = ()) -> DataFrame:
    """by..., rank, values... of the mask's pixels in ``pixels``."""
    return ranked(pixels, mask, by).where("rank is not null").select(*by, "rank", *values)


def packed_lines(series: DataFrame, mask: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """A sparse series (by..., rank, value) as a row a line: by..., row, values: array by place in the line, with null where the series has none."""
    at = placed(series, mask, by).join(mask.select(*by, "row", "before", "n"), [*by, "row"])
    found = at.groupBy(*by, "row", "n").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") - F.col("before")).alias("k"), F.col(value).alias("v")))).alias("__m"))
    return found.select(*by, "row", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.try_element_at("__m", k)).alias("values"))


def unpacked_line(runs: Column, values: Column, width: Column | int) -> Column:
    """A line's dense array of ``width`` columns from its sparse values, null outside the mask: by offsets alone."""
    def one(c):
        hit = F.get(F.filter(runs, lambda r: (r["c0"] <= c) & (c <= r["c1"])), F.lit(0))
        return F.get(values, (hit["rank"] + (c - hit["c0"])).cast("int"))

    return F.transform(F.sequence(F.lit(0).cast("long"), (F.lit(width) if isinstance(width, int) else width).cast("long") - 1), one)


def dense(series: DataFrame, mask: DataFrame, value: str, width: int, height: int | None = None, by: list[str] = ()) -> DataFrame:
    """by..., row, col, value of whole lines of ``width`` pixels: those of the mask, or with ``height`` all of 0 to height - 1; null outside the mask."""
    lines = mask.join(packed_lines(series, mask, value, by), [*by, "row"], "left").select(*by, "row", unpacked_line(F.col("runs"), F.col("values"), width).alias("__v"))
    if height is not None:
        images = mask.select(*by).distinct() if by else mask.sparkSession.range(1).select()
        every = images.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("row"))
        lines = every.join(lines, [*by, "row"], "left")
        lines = lines.withColumn("__v", F.coalesce("__v", F.array_repeat(F.lit(None).cast(series.schema[value].dataType), width)))
    return lines.select(*by, "row", F.posexplode("__v").alias("col", value)).withColumn("col", F.col("col").cast("long"))
