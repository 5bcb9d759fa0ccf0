"""Keyed results that are made once: caches and slices as Parquet, and image stacks by kind and date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def key(*columns: str, bits: int = 512) -> Column:
    """A digest of the columns' canonical JSON: by name in order, nulls included."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), bits)


def slice_name(relative_orbit: Column, slice_id: Column, milliseconds: int, row_margin: int, near_margin: int, far_margin: int, prefix: str = "") -> Column:
    """The name under which a slice and its metadata are kept."""
    orbit = F.lpad(relative_orbit.cast("string"), 3, "0")
    tail = f"_millisecs-{milliseconds}_rowmargin-{row_margin}_nearcolmargin-{near_margin}_farcolmargin-{far_margin}"
    return F.concat(F.lit(f"{prefix}orbit-"), orbit, F.lit("_slice_id-"), slice_id.cast("string"), F.lit(tail))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; none where nothing was put yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def missing(wanted: DataFrame, have: DataFrame | None, keys: list[str]) -> DataFrame:
    """Distinct keys wanted that aren't there; null keys count as equal."""
    wanted = wanted.select(*keys).distinct()
    if have is None:
        return wanted
    w, b = wanted.alias("w"), have.select(*keys).distinct().alias("b")
    return w.join(b, [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti")


def get_or_make(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored rows of the wanted keys, after those that are missing were made from their keys and appended.

    One writer at a time: two that append the same keys would store both. Readers see whole appends.
    """
    make(missing(wanted, stored(spark, path), keys)).write.mode("append").parquet(path)
    w = wanted.select(*keys).distinct().alias("w")
    have = spark.read.parquet(path).alias("b")
    return have.join(w, [F.col(f"b.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left_semi")


def put_image(df: DataFrame, root: str, kind: str, date: str) -> None:
    """Pixels of an image, a simulated phase or a map under its kind and date; what was there is replaced."""
    df.write.mode("overwrite").parquet(f"{root}/kind={kind}/date={date}")


def dates(spark: SparkSession, root: str) -> DataFrame:
    """Kinds and dates that are there."""
    return spark.read.parquet(root).select("kind", "date").distinct()


def stacked(images: DataFrame, *simulations: DataFrame) -> DataFrame:
    """Images (date, row, col, ...) beside simulated phases (date, row, col, own column); null where a date has none."""
    for s in simulations:
        images = images.join(s, ["date", "row", "col"], "left")
    return images
