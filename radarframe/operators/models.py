"""Sensor models bound to metadata: one struct for every sensor, so that tables that mix products are projected and localised in one go.

Points and image places are rows with the key of their product; a product's model is a row of its own. Both meet by product, and
products with many points are dealt to parts of about ``PART`` points, so no task holds one product's points whatever their number. In a
task the orbit is fitted once, and its points are solved as arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.functions.phase import LIGHT_SPEED
from radarframe.operators import correction, geometry

PART = 200_000
#: Seconds of ``first_azt`` and of the states count from the same, any, moment. Ground-range images have records (time, ground range of
#: column 0, slant range by ascending powers of metres on the ground and the other way about) instead of a range step.
MODEL = (
    "struct<sensor: string, states: array<struct<t: double, x: double, y: double, z: double, vx: double, vy: double, vz: double>>, first_azt: double, line_time: double, first_rng: double, range_step: double,"
    " width: int, height: int, right: boolean, wavelength: double, ground_range: array<struct<time: double, gr0: double, sr0: double, grsr: array<double>, srgr: array<double>>>>"
)


def _states(states: Column, listed: bool = False) -> Column:
    """States as parsers give them to the model's: positions and velocities are structs, or ``listed`` as arrays."""
    keys = (0, 1, 2) if listed else ("x", "y", "z")
    parts = [("position", k, n) for k, n in zip(keys, ("x", "y", "z"), strict=True)] + [("velocity", k, n) for k, n in zip(keys, ("vx", "vy", "vz"), strict=True)]
    return F.transform(states, lambda s: F.struct(s["time"].alias("t"), *(s[g][k].alias(n) for g, k, n in parts)))


def _struct(sensor: str, states: Column, **fields: Column) -> Column:
    given = {"sensor": F.lit(sensor), "states": states} | fields
    kinds = {p.split(":")[0].strip(): p.split(":", 1)[1].strip() for p in ("first_azt: double", "line_time: double", "first_rng: double", "range_step: double", "width: int", "height: int", "right: boolean", "wavelength: double")}
    parts = [given["sensor"].alias("sensor"), states.alias("states")]
    parts += [(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    record = "array<struct<time: double, gr0: double, sr0: double, grsr: array<double>, srgr: array<double>>>"
    parts.append((given["ground_range"] if "ground_range" in given else F.lit(None).cast(record)).alias("ground_range"))
    return F.struct(*parts)


def of_bursts(df: DataFrame) -> DataFrame:
    """product, model of bursts as ``metadata.slc_bursts`` reads them: the rows and columns of each burst's valid rectangle. Seconds are the parser's."""
    c = F.col
    first = (c("slant_range_time") + c("burst_roi.col") / c("range_frequency")) * LIGHT_SPEED / 2
    model = _struct(
        "s1-burst", _states(c("state_vectors")), first_azt=c("burst_times.start_valid"), line_time=1 / c("azimuth_frequency"), first_rng=first, range_step=LIGHT_SPEED / 2 / c("range_frequency"),
        width=c("burst_roi.w"), height=c("burst_roi.h"), right=F.lit(True), wavelength=c("wave_length"),
    )
    return df.select(F.concat_ws("#", "path", c("burst").cast("string")).alias("product"), model.alias("model"))


def of_grd(df: DataFrame) -> DataFrame:
    """product, model of ground-range products as ``metadata.grd_products`` reads them."""
    c = F.col
    records = F.array_sort(F.transform("srgr", lambda s: F.struct(*(s[k].alias(k) for k in ("time", "gr0", "sr0", "grsr", "srgr")))))
    model = _struct(
        "s1-grd", _states(c("state_vectors")), first_azt=c("image_start"), line_time=c("azimuth_time_interval"), range_step=c("range_pixel_spacing"), width=c("width"), height=c("height"), right=F.lit(True),
        wavelength=c("wave_length"), ground_range=records,
    )
    return df.select(c("path").alias("product"), model.alias("model"))


def of_terrasar(df: DataFrame) -> DataFrame:
    c = F.col
    model = _struct(
        "terrasar-x", _states(c("state_vectors")), first_azt=c("image_start"), line_time=c("azimuth_time_interval"), first_rng=c("slant_range_time") * LIGHT_SPEED / 2, range_step=c("range_time_interval") * LIGHT_SPEED / 2,
        width=c("width"), height=c("height"), right=c("look_side") == "right", wavelength=c("wavelength"),
    )
    return df.select(c("path").alias("product"), model.alias("model"))


def of_capella(df: DataFrame) -> DataFrame:
    c = F.col
    model = _struct(
        "capella", _states(c("state_vectors"), listed=True), first_azt=c("first_line_time"), line_time=c("delta_line_time"), first_rng=c("starting_range"), range_step=c("range_pixel_size"), width=c("width"), height=c("height"),
        right=c("look_direction") == "right", wavelength=c("wavelength"),
    )
    return df.select(c("path").alias("product"), model.alias("model"))


def of_cosmo(df: DataFrame) -> DataFrame:
    c = F.col
    model = _struct(
        "cosmo-skymed", _states(c("state_vectors"), listed=True), first_azt=c("image_start"), line_time=1 / c("azimuth_frequency"), first_rng=c("slant_range_time") * LIGHT_SPEED / 2, range_step=LIGHT_SPEED / 2 / c("range_sampling_rate"),
        width=c("width"), height=c("height"), right=c("look_side") == "right", wavelength=c("wavelength"),
    )
    return df.select(c("path").alias("product"), model.alias("model"))


def of_snap(df: DataFrame) -> DataFrame:
    """product, model of the products of DIMAP texts as ``metadata.snap_products`` reads them."""
    c = F.col
    model = _struct(
        "snap", _states(c("state_vectors")), first_azt=c("image_start"), line_time=1 / c("azimuth_frequency"), first_rng=c("slant_range_time") * LIGHT_SPEED / 2, range_step=c("range_pixel_spacing"), width=c("width"),
        height=c("height"), right=c("look_side") == "right", wavelength=c("wavelength"),
    )
    return df.select(F.concat_ws("#", "path", c("product").cast("string")).alias("product"), model.alias("model"))


class Bound:
    """A model in a task: its fitted orbit and the image's coordinates."""

    def __init__(self, model: Mapping):
        s = np.array([[p[k] for k in ("t", "x", "y", "z", "vx", "vy", "vz")] for p in model["states"]], float)
        self.orbit, self.model = geometry.Orbit.fit(s[:, 0], s[:, 1:4], s[:, 4:]), model
        found = model.get("ground_range")
        self.records = list(found) if found is not None and len(found) else None

    def _across(self, azt: np.ndarray, x: np.ndarray, inverse: bool) -> np.ndarray:
        """Slant range of ground ranges, or the other way about: polynomials of the two records around, linear in time between them, the nearest beyond them."""
        names = ("gr0", "grsr") if inverse else ("sr0", "srgr")
        times = np.array([r["time"] for r in self.records])
        values = np.stack([np.polynomial.polynomial.polyval(x - r[names[0]], r[names[1]]) for r in self.records])
        k = np.clip(np.searchsorted(times, azt, "right") - 1, 0, max(0, len(times) - 2))
        if len(times) == 1:
            return values[0]
        part = np.clip((azt - times[k]) / (times[k + 1] - times[k]), 0, 1)
        at = np.arange(len(x))
        return values[k, at] * (1 - part) + values[k + 1, at] * part

    def sensed(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Azimuth time and slant range of image places."""
        m = self.model
        azt = m["first_azt"] + row * m["line_time"]
        return azt, self._across(azt, col * m["range_step"], True) if self.records else m["first_rng"] + col * m["range_step"]

    def placed(self, azt: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of azimuth times and slant ranges."""
        m = self.model
        across = self._across(azt, rng, False) if self.records else rng - m["first_rng"]
        return (azt - m["first_azt"]) / m["line_time"], across / m["range_step"]


def _met(rows: DataFrame, models: DataFrame, names: list[str], keep: list[str], solve, out: str) -> DataFrame:
    """keep..., product and what ``solve(bound model, named columns)`` makes; null where a product has no model or one without enough states."""
    kinds = dict(rows.dtypes)
    parts = rows.groupBy("product").agg(F.expr(f"cast(count(*) div {PART} as int) + 1").alias("__parts"))
    dealt = rows.select("product", *keep, *(F.col(n).cast("double").alias(n) for n in names if n not in keep)).join(parts, "product").withColumn("__part", F.expr("cast(pmod(xxhash64(monotonically_increasing_id()), __parts) as int)")).drop("__parts")
    each = models.join(parts, "product").select("product", "model", F.explode(F.expr("sequence(0, __parts - 1)")).alias("__part"))
    fields = [x.strip().split()[0] for x in out.split(",")]

    def run(points, found):
        import pyarrow as pa

        kept = {"product": points.column("product"), **{k: points.column(k) for k in keep}}
        model = found.column("model").to_pylist()[0] if found.num_rows else None
        types = [pa.bool_() if x.strip().endswith("boolean") else pa.float64() for x in out.split(",")]
        if model is None or len(model["states"] or ()) < 2 or any(model[k] is None for k in ("first_azt", "line_time", "range_step")) or not points.num_rows:
            return pa.table({**kept, **{n: pa.nulls(points.num_rows, t) for n, t in zip(fields, types, strict=True)}})
        made = solve(Bound(model), *(points.column(n).to_numpy() for n in names))
        return pa.table({**kept, **{n: pa.array(v, t) for n, v, t in zip(fields, made, types, strict=True)}})

    schema = ", ".join([f"product {kinds['product']}", *(f"{k} {kinds[k]}" for k in keep), out])
    return dealt.groupBy("product", "__part").cogroup(each.groupBy("product", "__part")).applyInArrow(run, schema)


def project(points: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """product, keep..., row, col, azt, rng, incidence, converged of ground points (product, keep..., x, y, z) in their products' images."""

    def solve(b, x, y, z):
        azt, rng, incidence, done = geometry.closest_approach(b.orbit, np.stack([x, y, z], 1))
        return [*b.placed(azt, rng), azt, rng, incidence, done]

    return _met(points, models, ["x", "y", "z"], keep, solve, "row double, col double, azt double, rng double, incidence double, converged boolean")


def localize(places: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """product, keep..., x, y, z, converged of image places (product, keep..., row, col, alt)."""

    def solve(b, row, col, alt):
        azt, rng = b.sensed(row, col)
        m, done = geometry.on_ellipsoid(b.orbit, azt, rng, alt, bool(b.model["right"]))
        return [*(np.ascontiguousarray(m[:, k]) for k in range(3)), done]

    return _met(places, models, ["row", "col", "alt"], keep, solve, "x double, y double, z double, converged boolean")


def line_of_sight(points: DataFrame, models: DataFrame, keep: list[str], east_north_up: bool = False) -> DataFrame:
    """product, keep..., lx, ly, lz, azt, converged: unit vectors from the sensor to ground points (product, keep..., x, y, z, doppler) when they are sensed.

    That is when the point lies on the cone of its Doppler frequency, solved by Newton steps from the closest approach; with a Doppler of zero it is the closest
    approach. ``east_north_up`` gives the vectors in the axes at the point instead of earth-centred."""

    def solve(b, x, y, z, doppler):
        ground = np.stack([x, y, z], 1)
        azt, _, _, done = geometry.closest_approach(b.orbit, ground, b.model["wavelength"] / 2 * doppler)
        look = ground - b.orbit.at(azt)
        look /= np.linalg.norm(look, axis=1, keepdims=True)
        if east_north_up:
            look = in_axes(look, ground)
        return [*(np.ascontiguousarray(look[:, k]) for k in range(3)), azt, done]

    return _met(points, models, ["x", "y", "z", "doppler"], keep, solve, "lx double, ly double, lz double, azt double, converged boolean")


def in_axes(v: np.ndarray, ground: np.ndarray) -> np.ndarray:
    """Earth-centred vectors in the east, north and up axes at ground points."""
    lon, lat = np.radians(geometry.to_geodetic(ground)[:, :2]).T
    flat = np.cos(lon) * v[:, 0] + np.sin(lon) * v[:, 1]
    return np.stack([-np.sin(lon) * v[:, 0] + np.cos(lon) * v[:, 1], -np.sin(lat) * flat + np.cos(lat) * v[:, 2], np.cos(lat) * flat + np.sin(lat) * v[:, 2]], 1)


def sight_polynomials(models: DataFrame, alt: float = 0.0, size: int = 20, degree: int = 7, east_north_up: bool = False) -> DataFrame:
    """product, width, height, and lx, ly, lz as tables of coefficients by powers of the scaled column and row: a fit of lines of sight on size x size places of each image, on the ellipsoid raised by ``alt``.

    ``models`` may have a column ``centroid``: the Doppler centroid, ascending in slant range less the first one's; without it lines are of zero Doppler."""
    centroid = F.col("centroid") if "centroid" in models.columns else F.array(F.lit(0.0))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for one in pdf.to_dict("records"):
                b = Bound({**one["model"], "states": list(one["model"]["states"])})
                m = b.model
                cols, rows = (v.ravel() for v in np.meshgrid(np.linspace(0, m["width"] - 1, size), np.linspace(0, m["height"] - 1, size)))
                azt, rng = b.sensed(rows, cols)
                ground, _ = geometry.on_ellipsoid(b.orbit, azt, rng, np.full(len(azt), alt), bool(m["right"]))
                f = np.polynomial.polynomial.polyval(rng - rng.min(), np.asarray(one["centroid"], float))
                when = geometry.closest_approach(b.orbit, ground, m["wavelength"] / 2 * f)[0]
                look = ground - b.orbit.at(when)
                look /= np.linalg.norm(look, axis=1, keepdims=True)
                look = in_axes(look, ground) if east_north_up else look
                x, y = 2 * cols / (m["width"] - 1) - 1, 2 * rows / (m["height"] - 1) - 1
                powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
                fit = np.linalg.lstsq(np.stack([x**i * y**j for i, j in powers], 1), look, rcond=None)[0]
                tables = []
                for k in range(3):
                    table = [[0.0] * (degree + 1 - i) for i in range(degree + 1)]
                    for (i, j), v in zip(powers, fit[:, k], strict=True):
                        table[i][j] = float(v)
                    tables.append(table)
                yield pd.DataFrame({"product": [one["product"]], "width": [m["width"]], "height": [m["height"]], "lx": [tables[0]], "ly": [tables[1]], "lz": [tables[2]]})

    kind = dict(models.dtypes)["product"]
    table = "array<array<double>>"
    return models.select("product", "model", centroid.alias("centroid")).mapInPandas(run, f"product {kind}, width int, height int, lx {table}, ly {table}, lz {table}")


def sight(coefficients: Column, width: Column, height: Column, row: Column, col: Column) -> Column:
    """A component of the line of sight at an image place, from :func:`sight_polynomials`: a fold over the coefficients."""
    x, y = 2 * col / (width - 1) - 1, 2 * row / (height - 1) - 1
    inner = lambda t: F.aggregate(F.reverse(t), F.lit(0.0), lambda acc, v: acc * y + v)
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, t: acc * x + inner(t))


# projection in a secondary image, burst by burst


def in_bursts(points: DataFrame, bursts: DataFrame) -> DataFrame:
    """Points (acquisition, row, col, ... in the mosaic) once for each burst whose rectangle (acquisition, bsid, col, row, w, h) holds them: two where bursts overlap, none outside.

    An acquisition's bursts are folded into one row of some dozen rectangles, so points meet them by an equi-join."""
    box = F.struct("bsid", F.col("col").alias("x0"), F.col("row").alias("y0"), "w", "h")
    boxes = bursts.groupBy("acquisition").agg(F.sort_array(F.collect_list(box)).alias("__b"))
    x, y = F.col("col"), F.col("row")
    hits = F.filter("__b", lambda b: (x >= b["x0"]) & (x < b["x0"] + b["w"]) & (y >= b["y0"]) & (y < b["y0"] + b["h"]))
    return points.join(boxes, "acquisition").withColumn("__h", F.explode(hits)).select(points["*"], F.col("__h.bsid").alias("bsid"))


#: What a burst's corrections need; those without their fields are left out. ``bistatic``: (slant time, samples, sampling frequency) of the swath; ``doppler``: the ramp (:data:`resampling.RAMP`) of the burst;
#: ``chirp_rate`` for the shift within a pulse; ``fm_geometry`` for FM rates that differ from the processor's; ``path_delay`` whether the atmosphere's delay is added.
CORRECTIONS = "bistatic chirp_rate fm_geometry path_delay".split()


def doppler_at(ramp: Column, azt: Column, rng: Column) -> Column:
    """The Doppler frequency of a steered burst at a time (counted as the ramp's) and a slant range in metres."""
    tau = 2 * rng / LIGHT_SPEED
    series = lambda v, x: F.aggregate(F.reverse(v), F.lit(0.0), lambda acc, k: acc * x + k)
    f, fm = series(ramp["dc"][0], tau - ramp["dc_tau"]), series(ramp["fm"], tau - ramp["fm_tau"])
    mid = series(ramp["dc"][0], ramp["mid_tau"] - ramp["dc_tau"]) / series(ramp["fm"], ramp["mid_tau"] - ramp["fm_tau"])
    return f + fm * ramp["ks"] / (fm - ramp["ks"]) * (azt - (mid - f / fm))


def burst_chain(names: Sequence[str] = tuple(CORRECTIONS)) -> list[correction.Correction]:
    """Corrections from the columns of a point's burst: ``bistatic`` struct<slant_time, samples, frequency>, ``ramp`` with ``mid_azt``, ``chirp_rate``, ``fm_geometry``, and from the point's ``alt`` and ``incidence`` in degrees."""
    c = F.col
    tau = 2 * c("rng") / LIGHT_SPEED
    doppler = lambda: doppler_at(c("ramp"), c("azt") - c("mid_azt"), c("rng"))
    fm = lambda: F.aggregate(F.reverse("ramp.fm"), F.lit(0.0), lambda acc, k: acc * (tau - c("ramp.fm_tau")) + k)
    none = lambda v: F.coalesce(v, F.lit(0.0))
    chain = {
        "bistatic": lambda: {"azt": none(phase.bistatic(c("rng"), c("bistatic.slant_time"), c("bistatic.samples"), c("bistatic.frequency")))},
        "chirp_rate": lambda: {"rng": none(phase.intra_pulse(doppler(), c("chirp_rate")))},
        "fm_geometry": lambda: {"azt": none(phase.fm_mismatch(doppler(), c("fm_geometry"), fm()))},
        "path_delay": lambda: {"rng": none(phase.path_delay(c("alt"), F.radians("incidence")))},
    }
    return [chain[n] for n in names]


def secondary_projection(points: DataFrame, bursts: DataFrame, models: DataFrame, keep: list[str], names: Sequence[str] = tuple(CORRECTIONS)) -> DataFrame:
    """product, keep..., bsid, azt0, rng0, azt, rng, row, col: ground points (product, keep..., bsid, x, y, z, alt) in the bursts of secondary products, without corrections and with them.

    ``bursts`` (product, bsid, first_azt, line_time, first_rng, range_step and the columns of :func:`burst_chain`) gives each burst's own coordinates and corrections, ``models`` each
    product's orbit. Points were put to bursts by :func:`in_bursts`; a burst that the product doesn't have gives no row."""
    c = F.col
    seen = project(points, models, [*keep, "bsid", "alt"]).drop("row", "col")
    met = seen.join(bursts, ["product", "bsid"]).withColumns({"azt0": c("azt"), "rng0": c("rng")})
    done = correction.corrected(met, burst_chain(names))
    row, col = (c("azt") - c("first_azt")) / c("line_time"), (c("rng") - c("first_rng")) / c("range_step")
    return done.select("product", *keep, "bsid", "azt0", "rng0", "azt", "rng", row.alias("row"), col.alias("col"), "converged")


def without_corrections(places: DataFrame, names: Sequence[str] = tuple(CORRECTIONS), rounds: int = 3) -> DataFrame:
    """``places`` (azt, rng corrected, and the columns of :func:`burst_chain`) with azt and rng as the orbit alone would give them: shifts are estimated where the last round came to, since they are defined on uncorrected places."""
    c = F.col
    df = places.withColumns({"__azt": c("azt"), "__rng": c("rng")})
    for _ in range(rounds):
        moved = correction.corrected(df.withColumns({"__a": c("azt"), "__r": c("rng")}), burst_chain(names))
        df = moved.withColumns({"azt": c("__azt") - (c("azt") - c("__a")), "rng": c("__rng") - (c("rng") - c("__r"))}).drop("__a", "__r")
    return df.drop("__azt", "__rng")
