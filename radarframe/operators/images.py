"""Statistics of image pairs and amplitude images on pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radarframe.operators import raster
from radarframe.operators.raster import along


def crossed(pair: DataFrame) -> DataFrame:
    """``pair`` (.., r1, i1, r2, i2) with re, im of first times conjugate second, and the powers p1, p2; a pixel that lacks a part lacks all."""
    c = F.col
    parts = {"re": c("r1") * c("r2") + c("i1") * c("i2"), "im": c("i1") * c("r2") - c("r1") * c("i2"), "p1": c("r1") * c("r1") + c("i1") * c("i1"), "p2": c("r2") * c("r2") + c("i2") * c("i2")}
    whole = F.lit(True)
    for k in ("r1", "i1", "r2", "i2"):
        whole &= c(k).isNotNull() & ~F.isnan(k)
    return pair.withColumns({k: F.when(whole, v) for k, v in parts.items()})


def coherence(pair: DataFrame, half_rows: int, half_cols: int, edges: str = "inside", by: list[str] = ()) -> DataFrame:
    """row, col, coherence over (2 half_rows + 1) x (2 half_cols + 1) pixels.

    ``edges``: "inside" takes the means of the pixels there are, "replicate" lets edge pixels stand for those beyond, and "nan" leaves
    pixels without a whole window at NaN. Pixels without a value have none, and count as zero in the windows of others.
    """
    x = crossed(pair)
    names = ["re", "im", "p1", "p2"]
    if edges == "replicate":
        filled = x.select(*by, "row", "col", F.col("re").isNotNull().alias("__known"), *(F.coalesce(k, F.lit(0.0)).alias(k) for k in names))
        done = raster.weighted_box(filled, names, half_rows, half_cols, by).where("__known")
    else:
        done = raster.box_mean(x, names, half_rows, half_cols, by).where("re is not null")
    c = F.col
    value = F.sqrt(c("mean_re") * c("mean_re") + c("mean_im") * c("mean_im")) / (F.sqrt(c("mean_p1") * c("mean_p2")) + 1e-10)
    if edges == "nan":
        # the image's bounds: a row an image
        spot = x.where("re is not null").groupBy(*by).agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1"))
        done = done.join(spot, list(by)) if by else done.crossJoin(F.broadcast(spot))
        near = (c("row") - c("__r0") >= half_rows) & (c("__r1") - c("row") >= half_rows) & (c("col") - c("__c0") >= half_cols) & (c("__c1") - c("col") >= half_cols)
        value = F.when(near, value).otherwise(F.lit(float("nan")))
    return done.select(*by, "row", "col", value.alias("coherence"))


def multilooked(df: DataFrame, values: list[str], half_rows: int, half_cols: int, step_rows: int = 1, step_cols: int = 1, by: list[str] = ()) -> DataFrame:
    """Moving means, kept at every ``step_rows``-th line and ``step_cols``-th column."""
    done = raster.box_mean(df, values, half_rows, half_cols, by).where((F.col("row") % step_rows == 0) & (F.col("col") % step_cols == 0))
    return done.select(*by, "row", "col", *(F.col(f"mean_{v}").alias(v) for v in values))


def block_means(df: DataFrame, value: str, rows: int, cols: int, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col("row") / rows).alias("brow"), F.floor(F.col("col") / cols).alias("bcol")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def first_maxima(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Pixels with a whole 3 x 3 neighbourhood whose first largest one, line by line, they are."""
    w = along("col", "row", by)
    df = df.withColumns({"__l": F.lag(value).over(w), "__r": F.lead(value).over(w)})
    w = along("row", "col", by)
    three = F.struct(F.col("__l").alias("l"), F.col(value).alias("m"), F.col("__r").alias("r"))
    df = df.withColumn("__three", three).withColumns({"__up": F.lag("__three").over(w), "__low": F.lead("__three").over(w)})
    before = ["__up.l", "__up.m", "__up.r", "__l"]
    after = ["__r", "__low.l", "__low.m", "__low.r"]
    keep = F.lit(True)
    for k in before:
        keep &= F.col(value) > F.col(k)
    for k in after:
        keep &= F.col(value) >= F.col(k)
    return df.where(keep).drop("__l", "__r", "__three", "__up", "__low")


def top(df: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` largest pixels, first by line on ties."""
    return df.orderBy(F.desc_nulls_last(value), "row", "col").limit(n)


#: Values that may be sorted together in the last step of an exact percentile.
FEW_VALUES = 100_000


def percentiles(df: DataFrame, value: str, shares: list[float], bins: int = 2000) -> list[float | None]:
    """Exact percentiles with linear interpolation, however many values there are.

    Approximate percentiles on either side bound each wanted rank; what lies below is counted by plain comparisons, and bounds are narrowed among the values
    between them until those are few, or one value repeated, and are sorted. What reaches the driver is a row a step and two values a share.
    """
    own = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    near = lambda p: [min(1.0, max(0.0, p + d / bins)) for d in (-2, 2)]
    first = own.agg(F.count("*").alias("n"), F.percentile_approx("v", [x for p in shares for x in near(p)], bins).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    total = first["n"]
    if not total:
        return [None] * len(shares)
    ranks = [(int((total - 1) * p), min(total - 1, int((total - 1) * p) + 1)) for p in shares]
    bounds = [(first["q"][2 * k], first["q"][2 * k + 1]) for k in range(len(shares))]
    outer = [(first["lo"], first["hi"])] * len(shares)
    inside = lambda lo, hi: (F.col("v") >= lo) & (F.col("v") <= hi)
    settled: set[int] = set()
    while True:
        counts = own.agg(*(F.count(F.when(c, 1)) for lo, hi in bounds for c in (F.col("v") < lo, inside(lo, hi)))).first()
        narrow, missed = [], False
        for k, (lo, hi) in enumerate(bounds):
            below, within = counts[2 * k], counts[2 * k + 1]
            if not (below <= ranks[k][0] and ranks[k][1] < below + within):  # the approximation missed the rank: sort what held it before
                bounds[k], missed = outer[k], True
                settled.add(k)
            elif k not in settled and lo < hi and within > FEW_VALUES and bounds[k] != outer[k]:
                narrow.append(k)
        if missed:
            continue
        if not narrow:
            break
        shares_of = {k: [min(1.0, max(0.0, (r - counts[2 * k]) / counts[2 * k + 1] + d / bins)) for r, d in zip(ranks[k], (-2, 2), strict=True)] for k in narrow}
        found = own.agg(*(F.percentile_approx(F.when(inside(*bounds[k]), F.col("v")), shares_of[k], bins) for k in narrow)).first()
        for k, q in zip(narrow, found, strict=True):
            outer[k], bounds[k] = bounds[k], (q[0], q[1])
    # equal values take one row, so windows of many repeated values stay small
    parts = own.select("v", F.explode(F.array(*(F.when(inside(lo, hi), F.lit(k)) for k, (lo, hi) in enumerate(bounds)))).alias("b")).where("b is not null").groupBy("b", "v").agg(F.count("*").alias("n"))
    want = own.sparkSession.createDataFrame([(k, r - counts[2 * k], r) for k, both in enumerate(ranks) for r in sorted(set(both))], "b int, k long, rank long")
    got = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("v"))).join(F.broadcast(want), "b").where("k < upto and k >= upto - n").select("b", "rank", "v")
    value_at = {(r["b"], r["rank"]): r["v"] for r in got.collect()}
    out = []
    for k, p in enumerate(shares):
        x = (total - 1) * p
        a, b = (value_at[k, r] for r in ranks[k])
        out.append(a + (b - a) * (x - int(x)))
    return out


def stretched(df: DataFrame, value: str, low: float, high: float, out: str = "level") -> DataFrame:
    """``df`` with ``out``: the value between two bounds as a whole level of 0 to 255, cut downwards; without values nothing is added but nulls."""
    share = F.least(F.greatest((F.col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) if high > low else F.lit(0.0)
    return df.withColumn(out, F.floor(share * 255).cast("int"))


def edge_flags(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by..., left, right, top, bottom): whether fewer than half of the pixels on a side are valid (above 0)."""
    spot = df.groupBy(*by).agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1"))
    met = df.join(F.broadcast(spot), list(by)) if by else df.crossJoin(F.broadcast(spot))  # a row an image, on its four sides only
    valid = F.coalesce(F.col(value) > 0, F.lit(False)).cast("int")
    sides = {"left": F.col("col") == F.col("__c0"), "right": F.col("col") == F.col("__c1"), "top": F.col("row") == F.col("__r0"), "bottom": F.col("row") == F.col("__r1")}
    return met.groupBy(*by).agg(*((F.avg(F.when(on, valid)) < 0.5).alias(k) for k, on in sides.items()))


def border_masks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``inside``: beyond the first valid pixel of its line or column on every flagged side."""
    valid = F.coalesce(F.col(value) > 0, F.lit(False))
    line, column = Window.partitionBy(*by, "row"), Window.partitionBy(*by, "col")
    ends = {
        "left": F.col("col") >= F.min(F.when(valid, F.col("col"))).over(line), "right": F.col("col") <= F.max(F.when(valid, F.col("col"))).over(line),
        "top": F.col("row") >= F.min(F.when(valid, F.col("row"))).over(column), "bottom": F.col("row") <= F.max(F.when(valid, F.col("row"))).over(column),
    }
    flags = edge_flags(df, value, by).withColumnsRenamed({k: f"__{k}" for k in ends})
    met = df.withColumns({f"__in_{k}": F.coalesce(v, F.lit(False)) for k, v in ends.items()})
    met = met.join(F.broadcast(flags), list(by)) if by else met.crossJoin(F.broadcast(flags))
    inside: Column = F.lit(True)
    for k in ends:
        inside &= ~F.col(f"__{k}") | F.col(f"__in_{k}")
    return met.withColumn("inside", inside).select(*df.columns, "inside")
