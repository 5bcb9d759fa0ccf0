"""Interval, nearest-record and distance joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containment_join(segments: DataFrame, files: DataFrame, day: float = 1.0) -> DataFrame:
    """Pairs with file.start < segment.start and file.end > segment.end (both strict).

    A file is exploded to the days it covers; a segment has the one day of its start.
    """
    f = files.withColumn("__d", F.explode(F.sequence(F.floor(F.col("f_start") / day), F.floor(F.col("f_end") / day))))
    s = segments.withColumn("__d", F.floor(F.col("s_start") / day))
    return s.join(f, "__d").where("f_start < s_start and f_end > s_end").drop("__d")


def within_distance(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist) of distinct points (id, x, y) closer than ``radius``: a grid of that cell size, joined on the 3 x 3 cells."""
    cell = points.select("id", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    around = cell.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", step.alias("s"))
    around = around.select("a", "ax", "ay", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    dist = F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")))
    return around.join(cell, ["cx", "cy"]).select("a", F.col("id").alias("b"), dist.alias("dist")).where(f"a <> b and dist < {radius}")


def nearest_records(points: DataFrame, records: DataFrame, key: str, n: int = 1) -> DataFrame:
    """For each point (id, key, t) ``near``: the ``n`` nearest records (key, idx, rt, ...) of its key as (d, i, r), the first by idx on ties.

    Of records at one time only the n first can be among them. Points and records of a key are sorted together, and the last n records before a point and the first n
    behind it come by running windows, so a point meets 2 n records however many there are. Records without a time come after all others; a point without one has the first by idx.
    """
    own = [x for x in records.columns if x != key]
    others = [x for x in points.columns if x != key]
    some = lambda x: F.col(x).isNotNull() & ~F.isnan(x)
    r = records.select(key, F.col("rt").cast("double").alias("__t"), F.struct(F.col("idx").alias("i"), F.struct(*own).alias("r")).alias("__s"))
    first = lambda df, by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__s"))).where(F.col("__n") <= n).drop("__n")
    few = lambda df, out: first(df, [key]).groupBy(key).agg(F.array_sort(F.collect_list("__s")).alias(out))  # noqa: E731  n a key
    timed = first(r.where(some("__t")), [key, "__t"])
    up, down = Window.partitionBy(key).orderBy("__t", F.desc("__s")), Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__s"))
    run = lambda w: F.array("__s", *(F.lag("__s", k).over(w) for k in range(1, n)))  # noqa: E731  a record and those before it
    timed = timed.select(key, "__t", run(up).alias("__low"), run(down).alias("__high"))
    at = points.join(few(r, "__all"), key).join(few(r.where(~F.coalesce(some("__t"), F.lit(False))), "__rest"), key, "left")
    at = at.select(key, F.col("t").cast("double").alias("__t"), F.struct(*others, "__all", "__rest").alias("__p"))
    both = timed.withColumn("__k", F.lit(0)).unionByName(at.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    # records of a point's own time count as before it
    before = Window.partitionBy(key).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"__low": F.last("__low", ignorenulls=True).over(before), "__high": F.last("__high", ignorenulls=True).over(behind)}).where("__k = 1")
    both = both.select(key, "__p.*", "__low", "__high")
    ranked = "array_sort(transform(filter(concat(coalesce(__low, array()), coalesce(__high, array())), s -> s is not null), s -> named_struct('d', abs(s.r.rt - t), 'i', s.i, 'r', s.r)))"
    plain = lambda x: f"transform({x}, s -> named_struct('d', abs(s.r.rt - t), 'i', s.i, 'r', s.r))"
    near = F.expr(f"slice(if(t is null or isnan(t), {plain('__all')}, concat({ranked}, coalesce({plain('__rest')}, array()))), 1, {n})")
    return both.select(key, *others, near.alias("near"))


def best_containing(segments: DataFrame, files: DataFrame, rank: Column, longest: float, bin_width: float) -> DataFrame:
    """seg and the smallest ``rank`` (a struct over the file's columns) of the files that strictly contain each segment of at most ``longest``.

    Files of equal times are reduced to their best first. The time bins that a file holds whole, and the longest segment beyond them, are cut into dyadic runs:
    of n bins a file has at most 2 log n runs, which are reduced to their best by partial aggregates, and a segment looks up one run of each length. In the bins
    where files begin or end, files and segments are sorted together, and a running minimum gives each segment the best that began before it or ends behind it. Only files that
    begin and end in one bin meet its segments one by one. Segments without a file are left out.
    """
    f = files.withColumn("__r", rank).groupBy("f_start", "f_end").agg(F.min("__r").alias("__r"))
    span = f.agg(F.max(F.col("f_end") - F.col("f_start"))).first()[0] or 0.0
    levels = max(0, int(span / bin_width)).bit_length()
    # bins [__lo, __hi) are held whole
    f = f.withColumns({"__lo": (F.floor(F.col("f_start") / bin_width) + 1).cast("long"), "__hi": (F.ceil((F.col("f_end") - longest) / bin_width) - 1).cast("long")})
    # of each length p the run that begins and the run that ends the span, if it lies in the span and the one twice as long around it doesn't
    runs = (
        f"flatten(transform(sequence(0, {levels}), l -> transform(filter(transform(array_distinct(array(cast(ceil(__lo / shiftleft(1L, l)) as bigint), cast(floor(__hi / shiftleft(1L, l)) as bigint) - 1)),"
        " i -> struct(l, shiftleft(1L, l) as p, i as b, shiftright(i, 1) as up)),"
        " q -> q.b * q.p >= __lo and (q.b + 1) * q.p <= __hi and not (q.up * 2 * q.p >= __lo and (q.up + 1) * 2 * q.p <= __hi)), q -> struct(q.l as l, q.b as b))))"
    )
    whole = f.where("__lo < __hi").select("__r", F.explode(F.expr(runs)).alias("n")).groupBy("n.l", "n.b").agg(F.min("__r").alias("__r"))
    last = F.floor(F.col("f_end") / bin_width).cast("long")
    s = segments.withColumn("b", F.floor(F.col("s_start") / bin_width).cast("long"))
    # bins held but for their beginning, but for their end, and for neither
    begins = f.where("__lo - 1 < __hi").select((F.col("__lo") - 1).alias("b"), F.col("f_start").alias("t"), "__r")
    ends = f.select(F.explode(F.when(last >= F.greatest("__lo", "__hi"), F.sequence(F.greatest("__lo", "__hi"), last)).otherwise(F.array().cast("array<bigint>"))).alias("b"), F.col("f_end").alias("t"), "__r")
    inner = f.where("__lo - 1 >= __hi").select((F.col("__lo") - 1).alias("b"), "f_start", "f_end", "__r")

    def running(some: DataFrame, time: str, order: list[Column]) -> DataFrame:
        both = s.select("b", F.col(time).alias("t"), "seg", F.lit(0).alias("k"), F.lit(None).cast(some.schema["__r"].dataType).alias("__r"))
        both = both.unionByName(some.select("b", "t", F.lit(None).cast(segments.schema["seg"].dataType).alias("seg"), F.lit(1).alias("k"), "__r"))
        w = Window.partitionBy("b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("__r", F.min("__r").over(w)).where("k = 0 and __r is not null").select("seg", "__r")

    part = running(begins, "s_start", [F.col("t"), F.col("k")]).unionByName(running(ends, "s_end", [F.desc("t"), F.col("k")]))
    part = part.unionByName(s.join(inner, "b").where("f_start < s_start and f_end > s_end").select("seg", "__r"))
    probes = s.select("seg", F.explode(F.expr(f"transform(sequence(0, {levels}), l -> struct(l, shiftright(b, l) as b))")).alias("n")).select("seg", "n.l", "n.b")
    met = probes.join(whole, ["l", "b"]).select("seg", "__r").unionByName(part)
    return met.groupBy("seg").agg(F.min("__r").alias("best"))
