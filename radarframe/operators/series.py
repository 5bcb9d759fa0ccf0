"""Tables of products and bursts: grouping, completeness, pairing and merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_datatake(products: DataFrame) -> DataFrame:
    """platform, datatake, n, first_pid, day and pids of each datatake of products (platform, datatake, pid)."""
    return products.groupBy("platform", "datatake").agg(
        F.count("*").alias("n"), F.min("pid").alias("first_pid"), F.substring(F.min("pid"), 15, 8).alias("day"), F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("pids")
    )


def pid_parts(pid: Column | str) -> dict[str, Column]:
    """What a product's name says: mission, product_type, day and datatake."""
    part = F.split(pid, "_")
    return {"mission": part[0], "product_type": part[2], "day": F.substring(part[5], 1, 8), "datatake": part[6].cast("long")}


def orbit_queries(products: DataFrame, margin: float) -> DataFrame:
    """platform, datatake, q_start and q_end: the time that an orbit file must cover for each datatake."""
    return products.groupBy("platform", "datatake").agg((F.min("t0") - margin).alias("q_start"), (F.max("t1") + margin).alias("q_end"))


def consistent(rows: DataFrame, by: list[str], part: Column | str, bad: Column | str) -> DataFrame:
    """The groups in which no part is there twice and no row is bad."""
    part, bad = (F.col(x) if isinstance(x, str) else x for x in (part, bad))
    ok = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.countDistinct(part).alias("__d"), F.bool_or(bad).alias("__bad"))
    return ok.where("__n = __d and not coalesce(__bad, false)").select(*by)


def complete(rows: DataFrame, by: str, part: str, wanted: DataFrame | None = None) -> DataFrame:
    """The groups that have all ``wanted`` parts; without a table of them, all parts that any group has."""
    own = rows.select(by, part).distinct()
    if wanted is not None:
        own = own.join(F.broadcast(wanted.select(part).distinct()), part, "left_semi")
    need = (own if wanted is None else wanted).select(part).distinct().agg(F.count("*").alias("__need"))  # one row
    return own.groupBy(by).agg(F.count("*").alias("__have")).crossJoin(F.broadcast(need)).where("__have = __need").select(by)


def dropped(rows: DataFrame, by: str, part: str, wanted: DataFrame) -> DataFrame:
    """(by, missing): the groups that lack wanted parts, and which, in order: the log of what :func:`complete` leaves out."""
    all_parts = wanted.agg(F.array_sort(F.collect_set(part)).alias("__all"))  # one row: the parts of the primary image
    have = rows.groupBy(by).agg(F.collect_set(part).alias("__have"))
    return have.crossJoin(F.broadcast(all_parts)).select(by, F.array_except("__all", "__have").alias("missing")).where("size(missing) > 0")


def overlaps(bursts: DataFrame, rate: float, swath: str = "swath", burst: str = "burst") -> DataFrame:
    """Each burst (t0, t1) with the next of its swath that begins before it ends, and the lines they share."""
    w = Window.partitionBy(swath).orderBy("t0", burst)
    n = bursts.withColumn("next_burst", F.lead(burst).over(w)).withColumn("__next_t0", F.lead("t0").over(w)).where("__next_t0 < t1")
    return n.select(swath, burst, "next_burst", F.round((F.col("t1") - F.col("__next_t0")) * rate).cast("int").alias("overlap"))


def merged_slices(slices: DataFrame, by: str) -> DataFrame:
    """One record of the slices (height, width, t_start, t_end, vectors) of each image: heights add up, the widest counts, and each distinct
    state vector (t, ...) is kept once, in the order of time."""
    each = slices.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("height").alias("height"), F.max("width").alias("width"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("vectors")))).alias("vectors"),
    )
    return each.withColumn("n_vectors", F.size("vectors").cast("long"))


def esd_shift(phases: DataFrame, overlap: str, phi: str, doppler: str) -> DataFrame:
    """n, shift: the mean over overlaps of the azimuth time that their mean phase stands for, given the difference of the Doppler frequencies (Hz)."""
    b = phases.groupBy(overlap).agg(F.atan2(F.avg(F.sin(phi)), F.avg(F.cos(phi))).alias("__phi"), F.avg(doppler).alias("__f"))
    return b.agg(F.count("*").alias("n"), F.avg(F.col("__phi") / (2 * math.pi * F.col("__f"))).alias("shift"))


def set_ids(rows: DataFrame, by: str, member: str) -> DataFrame:
    """(by, bsint, osid): the members joined in order, and that behind the last one."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda x: x.cast("string")), "-")
    g = rows.groupBy(by).agg(keys.alias("bsint"), F.max(member).cast("string").alias("__last"))
    return g.select(by, "bsint", F.concat("__last", F.lit("__"), "bsint").alias("osid"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def without(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """The pairs (id1, id2) that aren't taken."""
    return pairs.select("id1", "id2").exceptAll(taken.select("id1", "id2"))


def sensor_time_range(row: Column, col: Column, azimuth_start: float, azimuth_rate: float, slant_start: float, range_rate: float, speed: float) -> tuple[Column, Column]:
    """Azimuth time and slant range of pixels."""
    return azimuth_start + row / azimuth_rate, (slant_start + col / range_rate) * speed / 2
