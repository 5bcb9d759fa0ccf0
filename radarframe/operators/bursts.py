"""Bursts of wide-swath acquisitions: numbers across an equator crossing, cuts between neighbours, and the rectangles that stitch them.

A burst table has acquisition, swath ('iw1' to 'iw3'), a relative ``burst`` number, its valid rectangle (col, row, w, h) in the
mosaic of the acquisition, and its valid times ``start`` and ``end`` in seconds. Windows hold one acquisition, some dozen bursts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radarframe.functions import phase

#: Longitude at which orbit 1 crosses the equator, in degrees; seconds around a crossing within which the orbit number may lag. Fixed values.
FIRST_NODE_LON, NEAR_NODE = 4.5, 50
T_ORBIT = 12 * 86400 / phase.CYCLE_ORBITS


def node_correction(anx_time: Column, first_anx_time: Column, lon: Column, relative_orbit: Column) -> Column:
    """Seconds to add to a burst's sensing time: an orbit less where its product began after the next node and its orbit number has moved on.

    ``anx_time`` and ``first_anx_time`` count from the ascending node, for the burst and its product's first burst; ``lon`` is the burst's mean longitude.
    """
    step = 360 / phase.CYCLE_ORBITS * 12
    expected = F.pmod(FIRST_NODE_LON - step * (relative_orbit - 1) + 180, F.lit(360.0)) - 180
    lagging = (F.abs(anx_time - T_ORBIT) < NEAR_NODE) & (F.abs(lon - expected) > step / 2)
    return F.when(~lagging & (first_anx_time > T_ORBIT), -T_ORBIT).otherwise(0.0)


def numbered(bursts: DataFrame) -> DataFrame:
    """Bursts as ``metadata.slc_bursts`` reads them, with relative_burst_id, absolute_burst_id and bsid."""
    c = F.col
    first = F.first("azimuth_anx_time").over(Window.partitionBy("path").orderBy("burst"))
    lon = F.expr("aggregate(approx_geom, 0D, (s, p) -> s + p.lon) / size(approx_geom)")
    moved = c("burst_sensing_time") + node_correction(c("azimuth_anx_time"), first, lon, c("relative_orbit_number"))
    mid = moved + c("pri") * (c("lines_per_burst") - 1) / 2
    relative, absolute = phase.burst_numbers(mid, c("anx_time"), c("relative_orbit_number"), c("absolute_orbit_number"))
    df = bursts.select("*", relative.alias("relative_burst_id"), absolute.alias("absolute_burst_id"))
    return df.withColumn("bsid", F.concat_ws("_", "relative_burst_id", "swath"))


def cut(bursts: DataFrame, azimuth_frequency: float) -> DataFrame:
    """Each burst with its inner rectangle ``inner`` (col, row, w, h) from its own corner: half of each overlap, and the part of its swath that no neighbour takes.

    Bursts of a swath overlap in time by a number of lines, of which the earlier gives up the larger half. Between two swaths
    the cut is midway from the least right edge of the one to the largest left edge of the other.
    """
    c = F.col
    swath = Window.partitionBy("acquisition", "swath")
    line = swath.orderBy("burst")
    edge = lambda s, x, pick: pick(F.when(c("swath") == s, x)).over(Window.partitionBy("acquisition"))
    left, right = c("col"), c("col") + c("w")
    midway = lambda a, b: F.coalesce(F.floor((edge(a, right, F.min) + edge(b, left, F.max)) / 2), edge(a, right, F.min), edge(b, left, F.max))
    df = bursts.withColumns({"__c12": midway("iw1", "iw2"), "__c23": midway("iw2", "iw3"), "__l": F.min(left).over(swath), "__r": F.max(right).over(swath)})
    at = lambda *by: F.when(c("swath") == "iw1", by[0]).when(c("swath") == "iw2", by[1]).otherwise(by[2])
    df = df.withColumns({"__x0": at(c("__l"), c("__c12"), c("__c23")) - c("col"), "__x1": at(c("__c12"), c("__c23"), c("__r")) - c("col")})
    after = F.coalesce(F.rint((c("end") - F.lead("start").over(line)) * azimuth_frequency), F.lit(0.0)).cast("long")
    df = df.withColumn("__o", after).withColumn("__p", F.coalesce(F.lag("__o").over(line), F.lit(0)))
    x0, x1, top = F.greatest(F.lit(0), c("__x0")), F.least(c("w"), c("__x1")), F.floor(c("__p") / 2)
    inner = F.struct(x0.cast("int").alias("col"), top.cast("int").alias("row"), (x1 - x0).cast("int").alias("w"), (c("h") - top - (c("__o") - F.floor(c("__o") / 2))).cast("int").alias("h"))
    return df.withColumn("inner", inner).drop("__c12", "__c23", "__l", "__r", "__x0", "__x1", "__o", "__p")


def stitched(cuts: DataFrame, roi: tuple[int, int, int, int]) -> DataFrame:
    """Bursts that meet a rectangle of the mosaic, with the part to ``read`` from each, from its own corner, and where to ``write`` it in the rectangle."""
    c = F.col
    col, row, w, h = (F.lit(v) for v in roi)
    wanted = F.struct(col.alias("col"), row.alias("row"), w.alias("w"), h.alias("h"))
    placed = F.struct((c("inner.col") + c("col")).alias("col"), (c("inner.row") + c("row")).alias("row"), c("inner.w").alias("w"), c("inner.h").alias("h"))
    df = cuts.withColumn("__m", phase.clip_roi(wanted, placed)).where("__m.w > 0")
    moved = lambda dx, dy: F.struct((c("__m.col") - dx).cast("int").alias("col"), (c("__m.row") - dy).cast("int").alias("row"), c("__m.w").alias("w"), c("__m.h").alias("h"))
    return df.withColumn("read", moved(c("col"), c("row"))).withColumn("write", moved(col, row)).drop("__m")


def assigned(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Points (acquisition, y, x in the mosaic) with the burst whose inner rectangle holds them: one burst a pixel, or none.

    An acquisition's bursts are folded into one row of some dozen rectangles, so points meet them by an equi-join.
    """
    box = F.struct("swath", "burst", (F.col("inner.col") + F.col("col")).alias("x0"), (F.col("inner.row") + F.col("row")).alias("y0"), F.col("inner.w").alias("w"), F.col("inner.h").alias("h"))
    boxes = cuts.groupBy("acquisition").agg(F.sort_array(F.collect_list(box)).alias("__b"))
    hit = F.get(F.filter("__b", lambda b: (F.col("x") >= b["x0"]) & (F.col("x") < b["x0"] + b["w"]) & (F.col("y") >= b["y0"]) & (F.col("y") < b["y0"] + b["h"])), F.lit(0))
    return points.join(boxes, "acquisition", "left").withColumn("__h", hit).select(points["*"], F.col("__h.swath").alias("swath"), F.col("__h.burst").alias("burst"))
