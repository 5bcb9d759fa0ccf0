"""Metadata of products kept in HDF5, from tables of what their files hold. The files themselves need a reader that isn't part of Spark.

COSMO-SkyMed products are rows (path, tags map<string, string>, width, height). NISAR products are rows
(path, name, numbers array<double>, texts array<string>, units), one a dataset, named by its path in the file.
A product that contradicts itself keeps its row, with what is wrong in ``problems``; one bad file doesn't stop a job over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radarframe.functions.phase import LIGHT_SPEED
from radarframe.sources.metadata import nanoseconds, numbers, seconds


def _listed(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold; one that can't be told doesn't."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda p: p.isNotNull())


def _triples(flat: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest((F.size(flat) / 3).cast("int") - 1, F.lit(0))), lambda k: F.slice(flat, k * 3 + 1, 3))


def cosmo(products: DataFrame) -> DataFrame:
    """One row a COSMO-SkyMed product, of the first or the second generation."""
    tag = lambda k: F.get(F.array(F.try_element_at("tags", F.lit(k))), F.lit(0))
    image = lambda k: F.when(tag("Mission_ID") == "CSG", tag(f"S01_IMG_{k}")).otherwise(tag(f"S01_SBI_{k}"))
    number = lambda v: v.try_cast("double")
    zero = seconds(F.replace(tag("Reference_UTC"), F.lit(" "), F.lit("T")))
    times, position, velocity = (numbers(tag(k)) for k in ("State_Vectors_Times", "ECEF_Satellite_Position", "ECEF_Satellite_Velocity"))
    states = F.transform(F.arrays_zip(times.alias("t"), _triples(position).alias("p"), _triples(velocity).alias("v")), lambda s: F.struct((zero + s["t"]).alias("time"), s["p"].alias("position"), s["v"].alias("velocity")))
    corner = lambda k: F.struct(F.get(numbers(image(f"{k}_Geodetic_Coordinates")), F.lit(1)).alias("lon"), F.get(numbers(image(f"{k}_Geodetic_Coordinates")), F.lit(0)).alias("lat"))
    direction, side = F.lower(tag("Orbit_Direction")), F.lower(tag("Look_Side"))
    checks = {
        "mission": tag("Mission_ID").isin("CSK", "CSG"), "light speed": number(tag("Light_Speed")) == LIGHT_SPEED, "orbit direction": direction.isin("ascending", "descending"), "look side": side.isin("left", "right"),
        "state vectors": (F.size(position) == 3 * F.size(times)) & (F.size(velocity) == 3 * F.size(times)),
    }
    return products.select(
        "path", "width", "height", tag("Mission_ID").alias("mission_id"), states.alias("state_vectors"), direction.alias("orbit_direction"), side.alias("look_side"),
        F.array(*(corner(k) for k in ("Top_Left", "Top_Right", "Bottom_Right", "Bottom_Left"))).alias("approx_geom"), (zero + number(image("Zero_Doppler_Azimuth_First_Time"))).alias("image_start"),
        (1 / number(image("Line_Time_Interval"))).alias("azimuth_frequency"), number(image("Zero_Doppler_Range_First_Time")).alias("slant_range_time"),
        F.coalesce(number(tag("RANGE_PIXEL_SPACING")), number(image("Column_Spacing"))).alias("range_pixel_spacing"), F.coalesce(number(tag("AZIMUTH_PIXEL_SPACING")), number(image("Line_Spacing"))).alias("azimuth_pixel_spacing"),
        number(tag("S01_Sampling_Rate")).alias("range_sampling_rate"), number(tag("Radar_Wavelength")).alias("wavelength"), numbers(tag("Centroid_vs_Range_Time_Polynomial")).alias("doppler_coefficients"), _listed(checks).alias("problems"),
    )


def nisar(datasets: DataFrame) -> DataFrame:
    """One row a NISAR product, with a struct each for frequencies A and B (null where there is no B)."""
    entry = F.struct("name", F.struct("numbers", "texts", "units").alias("d"))
    one = datasets.groupBy("path").agg(F.map_from_entries(F.collect_list(entry)).alias("__d"))
    band = F.when(F.exists(F.map_keys("__d"), lambda k: k.startswith("science/SSAR/")), "S").otherwise("L")
    one = one.withColumn("radar_band", band)

    def at(name: str) -> Column:
        return F.try_element_at("__d", F.concat(F.lit("science/"), F.col("radar_band"), F.lit(f"SAR/{name}")))

    ident, rslc = "identification", "RSLC"
    text = lambda name: F.get(at(name)["texts"], F.lit(0))
    values = lambda name: at(name)["numbers"]
    first = lambda name: F.get(values(name), F.lit(0))
    since = lambda name: F.get(F.split(at(name)["units"], " "), F.lit(2))
    swaths, orbit, geo, cal = f"{rslc}/swaths", f"{rslc}/metadata/orbit", f"{rslc}/metadata/geolocationGrid", f"{rslc}/metadata/calibrationInformation"

    def frequency(f: str) -> Column:
        g = f"{swaths}/frequency{f}"
        noise = F.when(at(f"{cal}/frequency{f}/nes0/slantRange").isNotNull(), "nes0").otherwise("noiseEquivalentBackscatter")
        either = lambda k: F.coalesce(values(f"{cal}/frequency{f}/nes0/{k}"), values(f"{cal}/frequency{f}/noiseEquivalentBackscatter/{k}"))
        polarizations = at(f"{g}/listOfPolarizations")["texts"]
        backscatter = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(p).alias("k"), either(p).alias("v")) for p in ("HH", "HV", "VH", "VV", "RH", "RV"))), lambda e: e["v"].isNotNull()))
        return F.when(at(f"{g}/slantRange").isNotNull(), F.struct(
            first(f"{g}/slantRange").alias("slant_range_first"), first(f"{g}/slantRangeSpacing").alias("slant_range_spacing"), first(f"{g}/sceneCenterGroundRangeSpacing").alias("ground_range_spacing"),
            first(f"{g}/sceneCenterAlongTrackSpacing").alias("azimuth_spacing"), first(f"{g}/acquiredCenterFrequency").alias("acquired_center_frequency"), first(f"{g}/processedCenterFrequency").alias("processed_center_frequency"),
            (LIGHT_SPEED / first(f"{g}/processedCenterFrequency")).alias("wavelength"), F.size(values(f"{g}/slantRange")).alias("width"), polarizations.alias("polarizations"), noise.alias("ne_backscatter_dataset"),
            either("zeroDopplerTime").alias("ne_backscatter_azimuth_time"), either("slantRange").alias("ne_backscatter_slant_range"), backscatter.alias("ne_backscatter"),
        ))

    states = F.transform(F.arrays_zip(values(f"{orbit}/time").alias("t"), _triples(values(f"{orbit}/position")).alias("p"), _triples(values(f"{orbit}/velocity")).alias("v")), lambda s: F.struct(s["t"].alias("time"), s["p"].alias("position"), s["v"].alias("velocity")))
    ring = F.regexp_extract_all(text(f"{ident}/boundingPolygon"), F.lit(r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)"), F.lit(0))
    corners = F.transform(ring, lambda p: F.struct(F.get(numbers(p), F.lit(0)).alias("lon"), F.get(numbers(p), F.lit(1)).alias("lat")))
    ref = since(f"{swaths}/zeroDopplerTime")
    start = nanoseconds(text(f"{ident}/zeroDopplerStartTime"))
    direction, side = F.lower(text(f"{ident}/orbitPassDirection")), F.lower(text(f"{ident}/lookDirection"))
    listed, has_b = at(f"{ident}/listOfFrequencies")["texts"], at(f"{swaths}/frequencyB/slantRange").isNotNull()
    track, frame = first(f"{ident}/trackNumber"), first(f"{ident}/frameNumber")
    checks = {
        "orbit direction": direction.isin("ascending", "descending"), "look side": side.isin("left", "right"), "relative orbit": (track > 0) & (track <= 173), "frame": (frame > 0) & (frame <= 176),
        "first line": start - nanoseconds(ref) == F.round(first(f"{swaths}/zeroDopplerTime") * 1e9).cast("long"),
        "reference times": (since(f"{orbit}/time") == ref) & (since(f"{geo}/zeroDopplerTime") == ref) & (since(f"{cal}/geometry/zeroDopplerTime") == ref),
        "frequencies": at(f"{swaths}/frequencyA/slantRange").isNotNull() & F.when(has_b, F.array_contains(listed, "B")).otherwise(listed == F.array(F.lit("A"))),
    }
    lut = {f"lut_{k}": values(f"{cal}/geometry/{n}") for k, n in (("beta0", "beta0"), ("gamma0", "gamma0"), ("sigma0", "sigma0"), ("slant_range", "slantRange"), ("azimuth_time", "zeroDopplerTime"))}
    gcps = {f"gcps_{k}": values(f"{geo}/{n}") for k, n in (("x", "coordinateX"), ("y", "coordinateY"), ("height", "heightAboveEllipsoid"), ("incidence_angle", "incidenceAngle"), ("slant_range", "slantRange"), ("azimuth_time", "zeroDopplerTime"))}
    return one.select(
        "path", "radar_band", text(f"{ident}/missionId").alias("mission_id"), text(f"{ident}/granuleId").alias("product_id"), direction.alias("orbit_direction"), side.alias("look_side"),
        first(f"{ident}/absoluteOrbitNumber").cast("int").alias("absolute_orbit_number"), track.cast("int").alias("relative_orbit_number"), frame.cast("int").alias("frame_number"), corners.alias("approx_geom"),
        seconds(ref).alias("ref_timestamp"), F.size(values(f"{swaths}/zeroDopplerTime")).alias("height"), first(f"{swaths}/zeroDopplerTime").alias("azimuth_time_first"), first(f"{swaths}/zeroDopplerTimeSpacing").alias("azimuth_time_interval"),
        frequency("A").alias("frequency_a"), frequency("B").alias("frequency_b"), states.alias("state_vectors"), *(v.alias(k) for k, v in {**gcps, **lut}.items()), first(f"{geo}/epsg").cast("int").alias("gcps_epsg"), _listed(checks).alias("problems"),
    )
