"""Phase unwrapping of whole rasters at least cost.

Residues are sources and sinks of turns, and a turn costs one for each gradient it crosses, so the cheapest flow pairs residues of either
sign by their distance along the grid, or takes them to the border. That is a matching of residues, far fewer than pixels: Spark
finds the residues, joins those near each other, and parts them into connected groups, each matched exactly, with dual prices. A pair further apart
than the join's radius can only matter where its prices add up to more than its distance; such pairs are joined in the next round, until
there are none, and then the whole raster is at its least cost. Pixels only meet in windows along rows and columns.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import network, raster

#: Residues that are matched in one task, about. Connected groups aren't parted, however large.
GROUP_RESIDUES = 4000


def matched(b_p: np.ndarray, b_n: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partners of positive residues (-1: the border) of least total cost, and the dual prices of either side.

    ``edges`` (positive, negative, distance) are the pairs allowed; the others cost their ways to the border. Shortest augmenting paths in
    reduced costs, one residue after the other; whole numbers throughout.
    """
    n_p, n_n = len(b_p), len(b_n)
    order = np.argsort(edges[0], kind="stable")
    at = np.searchsorted(edges[0][order], np.arange(n_p + 1)).tolist()
    to, cost = edges[1][order].tolist(), (edges[2][order] - b_n[edges[1][order]]).tolist()
    border = b_p.tolist()
    price, u = [0] * n_n, [0] * n_p  # of a negative residue less its way to the border, and of a positive one
    owner, mate = [-1] * n_n, [-1] * n_p
    for start in range(n_p):
        u[start] = min([border[start], *(cost[e] + price[to[e]] for e in range(at[start], at[start + 1]))])
        far, came, done, heap = {}, {}, {start: 0}, []
        person, reach, end = start, 0, None
        best_end = 1 << 60
        while True:
            here = reach + border[person] - u[person]
            if here < best_end:
                best_end, end = here, (person, -1)
            for e in range(at[person], at[person + 1]):
                j = to[e]
                there = reach + cost[e] + price[j] - u[person]
                if there < far.get(j, 1 << 60):
                    far[j], came[j] = there, person
                    heapq.heappush(heap, (there, j))
            person = None
            while heap:
                there, j = heapq.heappop(heap)
                if there > far[j]:
                    continue
                if there >= best_end:
                    heap.clear()
                    break
                if owner[j] < 0:
                    best_end, end = there, (came[j], j)
                    heap.clear()
                    break
                person, reach = owner[j], there
                done[person] = there
                break
            if person is None:
                break
        for i, d in done.items():
            if d < best_end:
                if mate[i] >= 0 and i != start:
                    price[mate[i]] += best_end - d
                u[i] += best_end - d
        i, j = end
        while True:
            before = mate[i]
            mate[i] = j
            if j >= 0:
                owner[j] = i
            if i == start:
                break
            i, j = came[before], before
    return np.array(mate, int), np.array(u, int), b_n - np.array(price, int)


def residue_points(df: DataFrame, by: list[str]) -> DataFrame:
    """by..., r, c, sign, border of each residue of df (by..., row, col, phi), as often as its charge: loops from 0, and their way to the border."""
    box = df.groupBy(*by).agg(F.min("row").alias("__r0"), F.min("col").alias("__c0"), (F.max("row") - F.min("row")).alias("__h"), (F.max("col") - F.min("col")).alias("__w"))
    found = raster.residues(df, phase.wrap, by).where("residue <> 0").select(*by, "row", "col", (-F.col("residue")).alias("charge")).join(box, by)
    r, c = F.col("row") - F.col("__r0"), F.col("col") - F.col("__c0")
    way = F.least(r + 1, F.col("__h") - r, c + 1, F.col("__w") - c)
    return found.select(*by, r.cast("int").alias("r"), c.cast("int").alias("c"), F.signum("charge").cast("int").alias("sign"), way.cast("int").alias("border"), F.col("__h").cast("int").alias("h"), F.col("__w").cast("int").alias("w"), F.explode(F.sequence(F.lit(1), F.abs("charge"))).alias("k")).drop("k")


def near(positive: DataFrame, negative: DataFrame, by: list[str], radius: int, limit: Column | None = None) -> DataFrame:
    """Pairs (by..., p, n, d) within a radius that may cost less than their ways to the border. Points meet in squares as wide as the radius."""
    cell = lambda a: F.floor(F.col(a) / radius)
    around = lambda a: F.explode(F.sequence(cell(a) - 1, cell(a) + 1))
    a = positive.select(*by, F.col("point").alias("p"), F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("border").alias("b1"), *([F.col("price").alias("u")] if limit is not None else []), cell("r").alias("__y"), cell("c").alias("__x"))
    b = negative.select(*by, F.col("point").alias("n"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("border").alias("b2"), *([F.col("price").alias("v")] if limit is not None else []), around("r").alias("__y"), F.col("c"))
    b = b.withColumn("__x", around("c")).drop("c")
    d = F.abs(F.col("r1") - F.col("r2")) + F.abs(F.col("c1") - F.col("c2"))
    met = a.join(b, [*by, "__y", "__x"]).withColumn("d", d).where((F.col("d") <= radius) & (F.col("d") < F.col("b1") + F.col("b2")))
    return (met if limit is None else met.where(limit)).select(*by, "p", "n", "d")


def pairing(points: DataFrame, by: list[str], checkpoint: Callable[[DataFrame], DataFrame], radius: int = 6) -> DataFrame:
    """``points`` (by..., point, r, c, sign, border, ...) with ``mate``, the other residue's number (null: the border), at least cost, and ``price``."""
    sides = {s: points.where(F.col("sign") == s) for s in (1, -1)}
    edges = checkpoint(near(sides[1], sides[-1], by, radius))
    groups = max(1, -(-points.count() // GROUP_RESIDUES))
    kinds = dict(points.dtypes)
    kept = [c for c in points.columns]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "mate long", "price long"])

    def solve(some, pairs):
        import pyarrow as pa

        sign, ids, border = (some.column(c).to_numpy() for c in ("sign", "point", "border"))
        p, n = np.nonzero(sign > 0)[0], np.nonzero(sign < 0)[0]
        p, n = p[np.argsort(ids[p])], n[np.argsort(ids[n])]
        a, b, d = (pairs.column(c).to_numpy() for c in ("p", "n", "d"))
        mate, u, v = matched(border[p].astype(np.int64), border[n].astype(np.int64), (np.searchsorted(ids[p], a), np.searchsorted(ids[n], b), d.astype(np.int64)))
        other, price = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        other[p[mate >= 0]] = ids[n[mate[mate >= 0]]]
        other[n[mate[mate >= 0]]] = ids[p[mate >= 0]]
        price[p], price[n] = u, v
        return some.drop_columns(["__g"]).append_column("mate", pa.array(other, pa.int64(), mask=other < 0)).append_column("price", pa.array(price, pa.int64()))

    while True:
        labels = network.components(points.select(F.col("point").alias("id")), edges.select(F.col("p").alias("a"), F.col("n").alias("b")), checkpoint)
        group = labels.select(F.col("id").alias("point"), F.pmod(F.xxhash64("component"), F.lit(groups)).alias("__g"))
        dealt = points.join(group, "point").select(*kept, "__g")
        linked = edges.join(group.select(F.col("point").alias("p"), F.col("__g").alias("__k")), "p").select("p", "n", "d", F.col("__k").alias("__g"))
        done = checkpoint(dealt.groupBy("__g").cogroup(linked.groupBy("__g")).applyInArrow(solve, schema))
        tops = tuple(done.agg(F.max(F.when(F.col("sign") > 0, F.col("price"))), F.max(F.when(F.col("sign") < 0, F.col("price")))).first())
        if None in tops or sum(tops) <= radius + 1:
            return done
        # pairs that weren't joined and whose prices are above their distance
        wide = int(sum(tops)) - 1
        dear = {1: done.where((F.col("sign") > 0) & (F.col("price") + int(tops[1]) > radius + 1)), -1: done.where((F.col("sign") < 0) & (F.col("price") + int(tops[0]) > radius + 1))}
        more = near(dear[1], dear[-1], by, wide, F.col("d") < F.col("u") + F.col("v")).join(edges.select("p", "n"), ["p", "n"], "left_anti")
        more = checkpoint(more)
        if more.isEmpty():
            return done
        edges = checkpoint(edges.unionByName(more))


def gates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by..., axis (0: between columns, 1: between rows), r, c, turns: gradients that matched residues' paths cross, and by how many turns they are off."""
    c = F.col
    other = pairs.where("sign < 0").select(c("point").alias("mate"), c("r").alias("r2"), c("c").alias("c2"))
    two = pairs.where("sign > 0 and mate is not null").select(*by, "mate", "r", "c").join(other, "mate")

    def steps(axis: int, first: Column, last: Column, r: Column | None, col: Column | None):
        # from first to last along an axis: each gate between two loops has the later one's number
        down = last > first
        at = F.when(first == last, F.array().cast("array<int>")).when(down, F.sequence(first + 1, last)).otherwise(F.sequence(last + 1, first))
        return lambda df: df.select(*by, F.explode(at).alias("__at"), F.when(down, 1).otherwise(-1).alias("turns"), (r if r is not None else F.lit(0)).alias("__r"), (col if col is not None else F.lit(0)).alias("__c")).select(
            *by, F.lit(axis).alias("axis"), (c("__at") if r is None else c("__r")).alias("r"), (c("__at") if col is None else c("__c")).alias("c"), "turns"
        )

    found = steps(0, c("r"), c("r2"), None, c("c"))(two).unionByName(steps(1, c("c"), c("c2"), c("r2"), None)(two))
    alone = pairs.where("mate is null")
    up, down, left = c("border") == c("r") + 1, c("border") == c("h") - c("r"), c("border") == c("c") + 1
    ends = [(up, 0, F.lit(-1)), (~up & down, 0, c("h")), (~up & ~down & left, 1, F.lit(-1)), (~up & ~down & ~left, 1, c("w"))]
    for fits, axis, last in ends:
        some = alone.where(fits)
        one = steps(axis, c("r") if axis == 0 else c("c"), last, None if axis == 0 else c("r"), None if axis == 1 else c("c"))
        positive, negative = (one(some.where(f"sign {s} 0")) for s in "><")
        found = found.unionByName(positive).unionByName(negative.withColumn("turns", -c("turns")))
    return found.groupBy(*by, "axis", "r", "c").agg(F.sum("turns").alias("turns")).where("turns <> 0")


def crossings(df: DataFrame, by: list[str], checkpoint: Callable[[DataFrame], DataFrame], radius: int = 6) -> DataFrame:
    """The gates of df (by..., row, col, phi), a table of whole rectangles; their turns' absolute values add up to the least cost."""
    points = checkpoint(residue_points(df, by).withColumn("point", F.monotonically_increasing_id()))
    return gates(pairing(points, by, checkpoint, radius), by)


def unwrapped(df: DataFrame, by: list[str], checkpoint: Callable[[DataFrame], DataFrame], radius: int = 6) -> DataFrame:
    """by..., row, col, phi, unwrapped: a surface congruent with df (by..., row, col, phi) that breaks as few gradients as any, over each whole raster.

    Rasters are whole rectangles, a row a pixel; pixels without a phase take the value of none on the way and get none. ``by`` names at least
    one column. ``checkpoint`` cuts a table's lineage: residues, pairs and matches are kept by it, pixels never.
    """
    known = df.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.nanvl(F.col("phi").cast("double"), F.lit(None)).alias("phi"))
    filled = known.withColumn("__known", F.col("phi").isNotNull()).withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    crossed = checkpoint(crossings(filled, by, checkpoint, radius))
    corner = filled.groupBy(*by).agg(F.min("row").alias("__r0"), F.min("col").alias("__c0"))
    crossed = crossed.join(corner, by).select(*by, "axis", (F.col("r") + F.col("__r0")).alias("row"), (F.col("c") + F.col("__c0")).alias("col"), "turns", "__c0")
    right = crossed.where("axis = 0").select(*by, "row", (F.col("col") + 1).alias("col"), F.col("turns").alias("__n"))
    down = crossed.where("axis = 1 and col = __c0").select(*by, (F.col("row") + 1).alias("row"), F.col("turns").alias("__m"))
    along = Window.partitionBy(*by, "row").orderBy("col")
    steps = filled.join(right, [*by, "row", "col"], "left").withColumn("__dx", F.coalesce(phase.wrap(F.col("phi") - F.lag("phi").over(along)), F.lit(0.0)) + 2 * F.pi() * F.coalesce("__n", F.lit(0)))
    steps = steps.withColumn("__x", F.sum("__dx").over(along))
    first = filled.join(corner, by).where("col = __c0").select(*by, "row", F.col("phi").alias("__p")).join(down, [*by, "row"], "left")
    whole = Window.partitionBy(*by).orderBy("row")  # a pixel a row of the raster
    first = first.withColumn("__dy", F.coalesce(phase.wrap(F.col("__p") - F.lag("__p").over(whole)), F.lit(0.0)) - 2 * F.pi() * F.coalesce("__m", F.lit(0)))
    first = first.select(*by, "row", (F.sum("__dy").over(whole) + F.first("__p").over(whole)).alias("__y"))
    surface = F.col("__x") + F.col("__y")
    done = F.col("phi") + 2 * F.pi() * F.rint((surface - F.col("phi")) / (2 * F.pi()))
    return steps.join(first, [*by, "row"]).select(*by, "row", "col", F.when(F.col("__known"), F.col("phi")).alias("phi"), F.when(F.col("__known"), done).alias("unwrapped"))
