"""Queries through metadata texts, catalogue areas and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from radarframe.operators import geometry, radar
from radarframe.plans.catalogue import query, table
from radarframe.plans.dense import circular_orbit
from radarframe.plans.pixels import pixels, points
from radarframe.sources import catalog, metadata

c = F.col


@query(
    """SELECT l_orderkey AS id, round(epoch(l_shipdate) + l_linenumber, 3) AS t, round(l_extendedprice, 2) AS x, round(l_discount, 2) AS y, round(l_tax, 2) AS z, l_quantity AS vx, CAST(l_partkey AS DOUBLE) AS vy, CAST(l_suppkey AS DOUBLE) AS vz FROM lineitem"""
)
def orbit_xml_parse(spark, sf_dir):
    """State vectors written as orbit files, one an order, and parsed back."""
    tag = lambda k, v: F.concat(F.lit(f'<{k} unit="m">'), v.cast("string"), F.lit(f"</{k}>"))
    stamp = F.date_format(F.timestamp_micros(F.unix_micros(c("l_shipdate").cast("timestamp")) + c("l_linenumber") * F.lit(1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    axes = {"X": c("l_extendedprice"), "Y": c("l_discount"), "Z": c("l_tax"), "VX": c("l_quantity"), "VY": c("l_partkey"), "VZ": c("l_suppkey")}
    # what is null has no element
    osv = F.concat_ws("", F.lit("<OSV>"), F.concat(F.lit("<UTC>UTC="), stamp, F.lit("</UTC>")), *(tag(k, v) for k, v in axes.items()), F.lit("</OSV>"))
    # an order's lines lie apart: dealt first, they are neither sorted nor collected before the shuffle, and their texts are made in generated code
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", osv.alias("osv")).repartition("l_orderkey")
    files = lines.groupBy("l_orderkey").agg(F.concat_ws("", F.collect_list("osv")).alias("s"))
    files = files.select(c("l_orderkey").cast("string").alias("path"), F.concat(F.lit("<F><Data_Block><List_of_OSVs>"), "s", F.lit("</List_of_OSVs></Data_Block></F>")).alias("text"))
    s = metadata.orbit_states(files)
    return s.select(c("path").cast("long").alias("id"), F.round("t", 3).alias("t"), *(F.round(k, 2).alias(k) for k in "xyz"), "vx", "vy", "vz")


@query(
    """SELECT c_custkey AS id FROM (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0 - 80 AS lat FROM customer) WHERE lon < 40 AND lon + 3 > -20 AND lat < 50 AND lat + 2 > -10"""
)
def catalog_area(spark, sf_dir):
    """Products whose footprint meets an area."""
    at = lambda dx, dy: F.struct((c("lon") + dx).alias("lon"), (c("lat") + dy).alias("lat"))
    p = points(spark, sf_dir).withColumn("footprint", F.array(at(0, 0), at(3, 0), at(3, 2), at(0, 2)))
    return p.where(catalog.meets("footprint", [(-20.0, -10.0), (40.0, -10.0), (40.0, 50.0), (-20.0, 50.0)])).select("id")


_AZT, _FREQUENCY, _RNG, _STEP = -20.0, 40.0, 850_000.0, 60.0


def terrain(spark, sf_dir):
    """A height model on a grid regular in time and range, with the raster as heights."""
    r = pixels(spark, sf_dir)
    at = r.select(F.struct("row", "col", "v").alias("id"), (_AZT + c("row") * 1.1 / _FREQUENCY).alias("azt"), (_RNG + c("col") * _STEP * 1.2).alias("rng"), (c("v") * 20).alias("alt"))
    # lines far behind the orbit's state vectors have no place on the ground
    return geometry.localize(at, circular_orbit()).where("converged").select("id.row", "id.col", "id.v", "x", "y", "z")


@query()
def dem_radarcode(spark, sf_dir):
    nodes = radar.image_nodes(terrain(spark, sf_dir), circular_orbit(), _AZT, _FREQUENCY, _RNG, _STEP)
    done = radar.radarcoded(nodes, "v")
    return done.select("line", "sample", F.round("v", 4).alias("v"))


@query()
def simulate(spark, sf_dir):
    done = radar.simulated(terrain(spark, sf_dir), circular_orbit(), _AZT, _FREQUENCY, _RNG, _STEP, _STEP * 170.0)
    return done.select("line", "sample", F.round("area", 4).alias("area"))
