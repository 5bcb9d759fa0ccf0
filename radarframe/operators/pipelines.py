"""Whole products from the single operators: interferograms of a stack, radiometric correction by stored slices, ground-range crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import bursts, kernels, ortho, raster, registration, resampling


def interferograms(images: DataFrame, pairs: DataFrame, simulated: Sequence[DataFrame] = (), looks: tuple[int, int] = (2, 8), goldstein: tuple[int, int, float] | None = None) -> DataFrame:
    """Pairs (date1, date2) of images (date, row, col, re, im), multilooked: (date1, date2, row, col, re, im, coherence).

    Each simulated phase (date, row, col, phi) is added to its image first, so the difference of both dates' phases turns the
    interferogram; a date without one is turned by nothing. Looks are sums in cells, so they combine before the shuffle. ``goldstein`` (step, window, alpha)
    filters each multilooked interferogram; the coherence stays that of the looks.
    """
    z = images
    for k, s in enumerate(simulated):
        z = z.join(s.select("date", "row", "col", F.col("phi").alias(f"__f{k}")), ["date", "row", "col"], "left")
    f = sum((F.coalesce(f"__f{k}", F.lit(0.0)) for k in range(len(simulated))), F.lit(0.0))
    turned = z.select("date", "row", "col", phase.times_conj(phase.complex_of(F.col("re"), F.col("im")), phase.complex_of(F.cos(f), -F.sin(f))).alias("z")) if simulated else z.select("date", "row", "col", phase.complex_of(F.col("re"), F.col("im")).alias("z"))
    one = pairs.join(turned.withColumnsRenamed({"date": "date1", "z": "a"}), "date1")
    both = one.join(turned.withColumnsRenamed({"date": "date2", "z": "b"}), ["date2", "row", "col"])
    cell = both.select("date1", "date2", F.floor(F.col("row") / looks[0]).alias("row"), F.floor(F.col("col") / looks[1]).alias("col"), phase.times_conj(F.col("a"), F.col("b")).alias("z"), phase.power(F.col("a")).alias("p"), phase.power(F.col("b")).alias("q"))
    mean = cell.groupBy("date1", "date2", "row", "col").agg(F.avg("z.re").alias("re"), F.avg("z.im").alias("im"), F.avg("p").alias("p"), F.avg("q").alias("q"))
    coherence = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.sqrt(F.col("p") * F.col("q")) + 1e-10)
    done = mean.select("date1", "date2", "row", "col", "re", "im", coherence.alias("coherence"))
    if goldstein is None:
        return done
    step, window, alpha = goldstein
    smooth = kernels.goldstein_filter(done, step, window, alpha, by=["date1", "date2"])
    return smooth.join(done.drop("re", "im"), ["date1", "date2", "row", "col"])


def slices_between(first: Column, last: Column, anx: Column, seconds: float) -> Column:
    """Ids of the time slices that an image's first to last line touch, counted from the ascending node."""
    return F.sequence(F.floor((first - anx) / seconds).cast("int"), (F.ceil((last - anx) / seconds) - 1).cast("int"))


def normalized_by_slices(image: DataFrame, slices: DataFrame, simulated: DataFrame) -> DataFrame:
    """Amplitudes (row, col, amp) normalised by simulated slices: (row, col, amp, slice_id).

    ``slices`` (slice_id, dx, dy, w, h) are placed in the image by a translation, whose part below a pixel is interpolated in
    ``simulated`` (slice_id, row, col, v). A line belongs to the first slice with a value in it; a slice's last line, which
    simulation leaves too weak, belongs to none. Pixels of a line outside its slice stay as they are; a line without a slice has a null slice_id.
    """
    c = F.col
    lines = slices.where("h > 1 and w > 0").select("slice_id", "dx", "dy", "w", F.explode(F.sequence(F.expr("cast(dy as int)"), F.expr("cast(dy as int)") + c("h") - 2)).alias("row"))
    here = lines.withColumn("row", c("row").cast(image.schema["row"].dataType)).join(image.select("row", "col"), "row").where((c("col") >= F.expr("cast(dx as int)")) & (c("col") < F.expr("cast(dx as int)") + c("w")))
    at = here.select("slice_id", c("row").alias("__i"), c("col").alias("__j"), (c("row") - c("dy")).alias("y"), (c("col") - c("dx")).alias("x"))
    got = ortho.sampled(simulated, at, ["v"], ["slice_id", "__i", "__j"], ["slice_id"])
    owner = F.min(F.when(c("v").isNotNull(), c("slice_id"))).over(Window.partitionBy("__i"))
    own = got.withColumn("__o", owner).where("slice_id = __o").select(c("__i").alias("row"), c("__j").alias("col"), "slice_id", "v")
    amp = F.when(c("slice_id").isNull(), c("amp")).otherwise(phase.rtc_normalized(c("amp"), c("v")))
    return image.join(own, ["row", "col"], "left").select("row", "col", amp.alias("amp"), "slice_id")


def ground_range_crop(dn: DataFrame, mapped: DataFrame, one_take: bool = True, nearest: bool = False) -> DataFrame:
    """A crop (row, col, sigma) on the ground from digital numbers (datatake, row, col, dn, noise, factor): calibrated, without its border, pulled through ``mapped``.

    With ``one_take``, numbers of two datatakes make the query fail, as an image is of one pass.
    """
    if one_take:
        takes = dn.agg(F.min("datatake").alias("__a"), F.max("datatake").alias("__b")).select(F.assert_true(F.col("__a").eqNullSafe(F.col("__b")), "products of several datatakes").alias("__ok"))
        dn = dn.join(F.broadcast(takes), F.col("__ok").isNull())  # one row
    sigma = phase.calibrated(F.col("dn"), F.col("noise"), F.col("factor"))
    masked = raster.border_mask(dn.select("row", "col", "dn", sigma.alias("sigma")), "dn")
    return ortho.pulled(masked.select("row", "col", F.when(F.col("inside"), F.col("sigma")).alias("sigma")), mapped, ["sigma"], nearest)


def time_series(pixels: DataFrame, cuts: DataFrame, maps: DataFrame, primary: str, rectangle: tuple[int, int, int, int]) -> DataFrame:
    """A stack (date, row, col, re, im) of mosaics in a rectangle of the primary's mosaic.

    ``pixels`` (date, swath, burst, row, col, re, im) are bursts as read, ``cuts`` the primary's from ``bursts.cut`` (one acquisition), ``maps``
    (date, swath, burst, matrix, and ramp where there is one) take a primary burst's pixels to those of another date, whose ramp is off while it is interpolated. A date that lacks one of the primary's bursts that the
    rectangle needs has no mosaic, as its dates couldn't be compared everywhere.
    """
    keys = ["swath", "burst"]
    parts = bursts.stitched(cuts, rectangle)
    needed = parts.select(*keys)
    have = pixels.select("date", *keys).distinct().join(needed, keys)
    whole = have.groupBy("date").count().join(needed.agg(F.count("*").alias("count")), "count").select("date")
    kept = pixels.join(whole, "date", "left_semi")
    # each burst is resampled in the part that the mosaic reads, so no pixel is made that the cut drops
    read = maps.where(F.col("date") != primary).join(parts.select(*keys, "read"), keys).join(whole, "date", "left_semi")
    moved = resampling.warped(kept, read.withColumnRenamed("read", "rectangle"), ["date", *keys], ["re", "im"])
    own = kept.where(F.col("date") == primary).select("date", *keys, "row", "col", "re", "im")
    put = own.unionByName(moved).withColumn("acquisition", F.lit(0))
    return registration.mosaic(put, parts.withColumn("acquisition", F.lit(0)), ["date", "re", "im"]).select("date", "row", "col", "re", "im")
