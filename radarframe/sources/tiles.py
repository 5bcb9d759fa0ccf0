"""Rasters as Parquet: pixels (row, col, values) in folders of tile rows, so that a window reads what it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, tile: int = 1024) -> None:
    """``df`` with its pixels sorted by tile: a folder a row of tiles, and within it row groups of few columns."""
    cut = df.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("__c", F.floor(F.col("col") / tile))
    cut.repartition("tile_row", "__c").sortWithinPartitions("tile_row", "__c", "row", "col").drop("__c").write.partitionBy("tile_row").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(tile,)], "tile long").coalesce(1).write.json(f"{path}.layout")


def window(spark: SparkSession, path: str, col: int, row: int, w: int, h: int, boundless: bool = False) -> DataFrame:
    """The pixels of a rectangle; with ``boundless``, those beyond the raster too, with null values."""
    tile = spark.read.schema("tile long").json(f"{path}.layout").first()["tile"]
    df = spark.read.parquet(path)
    inside = df.where(F.col("tile_row").between(row // tile, (row + h - 1) // tile) & F.col("row").between(row, row + h - 1) & F.col("col").between(col, col + w - 1)).drop("tile_row")
    if not boundless:
        return inside
    grid = spark.range(h).select((F.col("id") + row).alias("row"), F.explode(F.sequence(F.lit(col).cast("long"), F.lit(col + w - 1).cast("long"))).alias("col"))
    return grid.join(inside, ["row", "col"], "left")
