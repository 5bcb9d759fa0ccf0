"""Resampling of whole images through affine maps, tile by tile, with azimuth ramps taken off before the interpolation and put back behind it.

Each pixel of a source image is sent to the tiles of the destination that its place, under the inverse map, comes near to: an
expression on the pixel and its image's map, so a halo costs copies of border pixels and no join by pixel. Tiles meet
their pixels in a cogroup, so a tile without pixels gives nulls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An azimuth ramp. Row 0 lies at ``t0`` seconds from the time the ramp counts from (a burst's middle), rows are ``dt`` apart; column 0 lies at
#: ``tau0`` (seconds of slant range, or metres for a ramp fitted so), columns ``dtau`` apart. ``fm`` is the FM rate, ascending in tau - ``fm_tau``; ``ks`` the steering rate in Hz a
#: second, null for an image without steering; ``dc`` the Doppler centroid, rows ascending in time, columns in tau - ``dc_tau``; ``mid_tau`` is the swath's middle.
RAMP = "struct<t0: double, dt: double, tau0: double, dtau: double, mid_tau: double, ks: double, fm: array<double>, fm_tau: double, dc: array<array<double>>, dc_tau: double>"
#: Pixels whose weights sum to less than this may be missing: rounding of weights that are none.
SLIGHT = 1e-9


def ramp_values(ramp: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The ramp's phase in radians at real places.

    With steering, pi kt (t - t_ref)^2 + 2 pi f (t - t_ref), where kt joins the FM and the steering rate and t_ref is when the beam's centre passes zero; else 2 pi f t."""
    poly = np.polynomial.polynomial
    t, tau = ramp["t0"] + ramp["dt"] * np.asarray(rows, float), ramp["tau0"] + ramp["dtau"] * np.asarray(cols, float)
    dc = np.asarray(ramp["dc"], float)
    f = poly.polyval2d(t, tau - ramp["dc_tau"], dc)
    if ramp["ks"] is None:
        return 2 * np.pi * f * t
    fm = poly.polyval(tau - ramp["fm_tau"], ramp["fm"])
    fm_mid, f_mid = poly.polyval(ramp["mid_tau"] - ramp["fm_tau"], ramp["fm"]), poly.polyval2d(0.0, ramp["mid_tau"] - ramp["dc_tau"], dc)
    late = t - (f_mid / fm_mid - f / fm)
    return (np.pi * fm * ramp["ks"] / (fm - ramp["ks"]) * late + 2 * np.pi * f) * late


def ramp_phase(ramp: Column, row: Column, col: Column) -> Column:
    """The same as a column."""
    t, tau = ramp["t0"] + ramp["dt"] * row, ramp["tau0"] + ramp["dtau"] * col

    def series(coefficients: Column, x: Column) -> Column:
        return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)

    def centroid(when: Column, where: Column) -> Column:
        return F.aggregate(F.reverse(ramp["dc"]), F.lit(0.0), lambda acc, c: acc * when + series(c, where - ramp["dc_tau"]))

    f, fm = centroid(t, tau), series(ramp["fm"], tau - ramp["fm_tau"])
    late = t - (centroid(F.lit(0.0), ramp["mid_tau"]) / series(ramp["fm"], ramp["mid_tau"] - ramp["fm_tau"]) - f / fm)
    steered = (F.pi() * fm * ramp["ks"] / (fm - ramp["ks"]) * late + 2 * F.pi() * f) * late
    return F.when(ramp["ks"].isNull(), 2 * F.pi() * f * t).otherwise(steered)


def taps(x: np.ndarray, method: str, lobes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of real places along an axis: the pixels that count, and their weights."""
    if method == "nearest":
        return np.rint(x).astype(int)[:, None], np.ones((len(x), 1))
    first = np.floor(x).astype(int)
    if method == "linear":
        return first[:, None] + np.arange(2), np.stack([1 - (x - first), x - first], 1)
    k = np.arange(-lobes + 1, lobes + 1)
    d = (x - first)[:, None] - k[None, :]
    w = np.sinc(d) * np.sinc(d / lobes)
    return first[:, None] + k, w / w.sum(1, keepdims=True)


def interpolated(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, method: str = "lanczos", lobes: int = 4) -> np.ndarray:
    """``image`` (NaN where there is none) at real places; NaN where a pixel that counts is missing."""
    edge = lobes + 1
    wide = np.pad(image, edge, constant_values=np.nan)
    lost = np.isnan(wide)
    wide = np.where(lost, 0, wide).ravel()
    lost = lost.ravel().astype(float)
    h, w = image.shape[0] + 2 * edge, image.shape[1] + 2 * edge
    shape, out = np.shape(rows), []
    rows, cols = np.ravel(rows).astype(float), np.ravel(cols).astype(float)
    for lo in range(0, len(rows), 1 << 16):
        far = slice(lo, lo + (1 << 16))
        (i, wi), (j, wj) = taps(np.clip(rows[far], -edge, h), method, lobes), taps(np.clip(cols[far], -edge, w), method, lobes)
        i, j = np.clip(i + edge, 0, h - 1) * w, np.clip(j + edge, 0, w - 1)
        total, missing = np.zeros(len(i), wide.dtype), np.zeros(len(i))
        for a in range(i.shape[1]):
            for b in range(j.shape[1]):
                at, weight = i[:, a] + j[:, b], wi[:, a] * wj[:, b]
                total += weight * wide[at]
                missing += np.abs(weight) * lost[at]
        total[missing > SLIGHT] = np.nan
        out.append(total)
    return (np.concatenate(out) if out else np.zeros(0, wide.dtype)).reshape(shape)


def warped(images: DataFrame, maps: DataFrame, by: list[str], values: list[str], method: str = "lanczos", lobes: int = 4, tile: int = 256, reramp: bool = True) -> DataFrame:
    """(by..., row, col, values...): each image (by..., row, col, values...) pulled into the rectangle of its map, at the primary's places.

    ``maps`` (by..., matrix, rectangle, ramp) has one row an image: ``matrix`` [a, b, c, d, e, f] takes (col, row) to a x + b y + c, d x + e y + f in the
    image, ``rectangle`` (col, row, w, h) is what is wanted of the primary, and ``ramp`` (:data:`RAMP`, may be lacking or null) is that of the image, whose values
    are then ``re`` and ``im``. ``reramp=False`` leaves the ramp off. Without a map, with a singular one, or where a pixel that counts is missing, values are null.
    """
    ramps = "ramp" in maps.columns
    if ramps and list(values) != ["re", "im"]:
        raise ValueError("a ramp is one of complex images: re and im")
    c, kinds = F.col, dict(maps.dtypes)
    maps = maps.select(*by, "matrix", c("rectangle").alias("__q"), *(["ramp"] if ramps else []))
    m = [F.get("matrix", F.lit(k)) for k in range(6)]
    det = m[0] * m[4] - m[1] * m[3]
    # the places of pixels in the primary, and how far their support reaches there
    x, y = c("col") - m[2], c("row") - m[5]
    reach = {"x": (F.abs(m[4]) + F.abs(m[1])) / F.abs(det) * (lobes + 1), "y": (F.abs(m[3]) + F.abs(m[0])) / F.abs(det) * (lobes + 1)}
    place = {"x": (m[4] * x - m[1] * y) / det - c("__q.col"), "y": (m[0] * y - m[3] * x) / det - c("__q.row")}

    def tiles(axis: str, size: str) -> Column:
        low = F.greatest(F.floor((place[axis] - reach[axis]) / tile), F.lit(0)).cast("int")
        high = F.least(F.floor((place[axis] + reach[axis]) / tile), F.ceil(c(f"__q.{size}") / tile) - 1).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))

    sent = images.select(*by, "row", "col", *values).join(maps.select(*by, "matrix", "__q").where(det != 0), by)
    sent = sent.select(*by, "row", "col", *values, "matrix", "__q", tiles("y", "h").alias("__r"))
    sent = sent.select(*by, "__r", tiles("x", "w").alias("__c"), c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), *(c(v).cast("double").alias(v) for v in values))
    wanted = maps.where("__q.w > 0 and __q.h > 0").withColumn("__r", F.explode(F.expr(f"sequence(0, cast(ceil(__q.h / {tile}) as int) - 1)")))
    wanted = wanted.withColumn("__c", F.explode(F.expr(f"sequence(0, cast(ceil(__q.w / {tile}) as int) - 1)")))

    def kernel(pixels, one):
        import pyarrow as pa

        if not one.num_rows:
            return pa.table({**{k: pixels.column(k).slice(0, 0) for k in by}, "row": pa.array([], pa.int64()), "col": pa.array([], pa.int64()), **{v: pa.array([], pa.float64()) for v in values}})
        row = one.slice(0, 1).to_pylist()[0]
        q, r0, c0 = row["__q"], row["__r"] * tile, row["__c"] * tile
        i, j = np.mgrid[q["row"] + r0 : q["row"] + min(q["h"], r0 + tile), q["col"] + c0 : q["col"] + min(q["w"], c0 + tile)]
        i, j = i.ravel(), j.ravel()
        made = {v: np.full(len(i), np.nan) for v in values}
        if pixels.num_rows:
            at = [pixels.column(k).to_numpy() for k in ("row", "col")]
            low = [int(a.min()) for a in at]
            shape = [int(a.max()) - b + 1 for a, b in zip(at, low, strict=True)]
            m = row["matrix"]
            x, y = m[0] * j + m[1] * i + m[2], m[3] * j + m[4] * i + m[5]
            ramp = row.get("ramp")

            def dense(given: np.ndarray) -> np.ndarray:
                held = np.full(shape, np.nan, given.dtype)
                held[at[0] - low[0], at[1] - low[1]] = given
                return held

            got = {v: pixels.column(v).to_numpy().astype(float) for v in values}
            if ramp is not None:
                z = (got["re"] + 1j * got["im"]) * np.exp(-1j * ramp_values(ramp, *at))
                z = interpolated(dense(z), y - low[0], x - low[1], method, lobes)
                if reramp:
                    z = z * np.exp(1j * ramp_values(ramp, y, x))
                made = {"re": z.real, "im": z.imag}
            else:
                made = {v: interpolated(dense(got[v]), y - low[0], x - low[1], method, lobes) for v in values}
        return pa.table({**{k: pa.array([row[k]] * len(i), one.schema.field(k).type) for k in by}, "row": pa.array(i, pa.int64()), "col": pa.array(j, pa.int64()), **{v: pa.array(made[v], pa.float64(), mask=np.isnan(made[v])) for v in values}})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "row long", "col long", *(f"{v} double" for v in values)])
    return sent.groupBy(*by, "__r", "__c").cogroup(wanted.groupBy(*by, "__r", "__c")).applyInArrow(kernel, schema)
