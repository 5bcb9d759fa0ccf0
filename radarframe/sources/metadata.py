"""Product metadata from XML and JSON texts to typed rows.

A product's metadata is one text of some megabytes, so a table of texts (path, text) is the unit: each
text is parsed once, by the engine's own parser with a fixed schema, and files spread over tasks. A text
that doesn't parse, or lacks a field, gives nulls. Times are seconds since 1970, UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radarframe.functions.phase import LIGHT_SPEED

VALUE = "struct<_VALUE: string>"
XYZ = "struct<x: double, y: double, z: double>"


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def seconds(stamp: Column) -> Column:
    """An ISO time, with or without zone letter, as seconds UTC."""
    zoned = F.when(stamp.endswith("Z"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    return F.unix_micros(F.to_timestamp(zoned)) / 1e6


def nanoseconds(stamp: Column) -> Column:
    """An ISO time with up to nine fractional digits as a long."""
    fraction = F.rpad(F.regexp_extract(stamp, r"\.(\d+)", 1), 9, "0")
    whole = F.unix_seconds(F.to_timestamp(F.concat(F.regexp_replace(stamp, r"(\.\d+)?Z?$", ""), F.lit("Z"))))
    return whole * 1_000_000_000 + F.coalesce(F.try_to_number(fraction, F.lit("999999999")).cast("long"), F.lit(0))


def numbers(text: Column, kind: str = "double") -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def _xml(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select("path", F.from_xml("text", schema, {"mode": "PERMISSIVE"}).alias("m")).select("path", "m.*")


# Element names of the products' formats.
_ORBIT = "Data_Block struct<List_of_OSVs: struct<OSV: array<struct<UTC: string, X: string, Y: string, Z: string, VX: string, VY: string, VZ: string>>>>"
_HEADER = "adsHeader struct<missionId: string, absoluteOrbitNumber: int, swath: string>"
_GENERAL = (
    "generalAnnotation struct<productInformation: struct<pass: string, rangeSamplingRate: double, radarFrequency: double, azimuthSteeringRate: double>,"
    f" orbitList: struct<orbit: array<struct<time: string, position: {XYZ}, velocity: {XYZ}>>>,"
    f" azimuthFmRateList: struct<azimuthFmRate: array<struct<azimuthTime: string, t0: double, c0: double, c1: double, c2: double, azimuthFmRatePolynomial: {VALUE}>>>,"
    " downlinkInformationList: struct<downlinkInformation: array<struct<downlinkValues: struct<pri: double, rank: double, txPulseRampRate: double>>>>>"
)
_IMAGE = (
    "imageAnnotation struct<imageInformation: struct<azimuthFrequency: double, slantRangeTime: double, ascendingNodeTime: string, sliceNumber: int, sliceList: struct<_count: int>, productFirstLineUtcTime: string,"
    " productLastLineUtcTime: string, azimuthTimeInterval: double, rangePixelSpacing: double, numberOfSamples: int, numberOfLines: int>, processingInformation: struct<dcMethod: string>>"
)
_DOPPLER = f"dopplerCentroid struct<dcEstimateList: struct<dcEstimate: array<struct<azimuthTime: string, t0: double, dataDcPolynomial: {VALUE}, geometryDcPolynomial: {VALUE}>>>>"
_TIMING = (
    "swathTiming struct<linesPerBurst: int, samplesPerBurst: int, burstList: struct<burst: array<struct<azimuthTime: string, azimuthAnxTime: double, sensingTime: string,"
    f" firstValidSample: {VALUE}, lastValidSample: {VALUE}>>>>"
)
_GRID = "geolocationGrid struct<geolocationGridPointList: struct<geolocationGridPoint: array<struct<line: int, pixel: int, longitude: double, latitude: double, height: double>>>>"
_CONVERSION = f"coordinateConversion struct<coordinateConversionList: struct<coordinateConversion: array<struct<azimuthTime: string, sr0: double, gr0: double, srgrCoefficients: {VALUE}, grsrCoefficients: {VALUE}>>>>"


def orbit_states(texts: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """path, t, x, y, z, vx, vy, vz of orbit files, both ends of the time span included."""
    osv = _xml(texts, _ORBIT).select("path", F.explode("Data_Block.List_of_OSVs.OSV").alias("s"))
    stamp = F.col("s.UTC")
    stamp = F.when(stamp.startswith("UTC="), F.substr(stamp, F.lit(5))).otherwise(stamp)
    # numbers are read as texts: an element read with its attributes (units, which nobody asks for) is an object of its own to the parser, six a state vector
    done = osv.select("path", seconds(stamp).alias("t"), *(F.col(f"s.{k}").try_cast("double").alias(k.lower()) for k in ("X", "Y", "Z", "VX", "VY", "VZ")))
    for bound, keep in ((start, lambda b: F.col("t") >= b), (end, lambda b: F.col("t") <= b)):
        done = done if bound is None else done.where(keep(bound))
    return done


def _states(orbits: str) -> Column:
    return F.transform(orbits, lambda s: F.named_struct(F.lit("time"), seconds(s["time"]), F.lit("position"), s["position"], F.lit("velocity"), s["velocity"]))


#: Offsets of the absolute orbit number, by satellite, and the orbits of a cycle. Fixed values.
ORBIT_OFFSET, ORBITS = {"S1A": 73, "S1B": 27, "S1C": -3, "S1D": 42}, 175


def relative_orbit(mission: Column, absolute: Column) -> Column:
    offset = F.coalesce(*(F.when(mission == k, v) for k, v in ORBIT_OFFSET.items()))
    return (F.pmod(absolute - offset, F.lit(ORBITS)) + 1).cast("int")


def _common(df: DataFrame) -> list[Column]:
    general, image = "generalAnnotation.productInformation", "imageAnnotation.imageInformation"
    c = F.col
    return [
        c("path"), c("adsHeader.missionId").alias("mission_id"), c("adsHeader.absoluteOrbitNumber").alias("absolute_orbit_number"),
        relative_orbit(c("adsHeader.missionId"), c("adsHeader.absoluteOrbitNumber")).alias("relative_orbit_number"), c(f"{general}.pass").alias("orbit_pass"),
        c(f"{image}.azimuthFrequency").alias("azimuth_frequency"), c(f"{image}.slantRangeTime").alias("slant_range_time"), seconds(c(f"{image}.ascendingNodeTime")).alias("anx_time"),
        c(f"{image}.sliceNumber").alias("slice_number"), c(f"{image}.sliceList._count").alias("slice_count"), c(f"{general}.rangeSamplingRate").alias("range_frequency"),
        (LIGHT_SPEED / c(f"{general}.radarFrequency")).alias("wave_length"), F.radians(f"{general}.azimuthSteeringRate").alias("steering_rate"),
        _states("generalAnnotation.orbitList.orbit").alias("state_vectors"), F.lit("orbpre").alias("state_vectors_origin"),
    ]


def slc_bursts(texts: DataFrame) -> DataFrame:
    """One row a burst of the annotation texts of SLC products: swath fields, times, the valid rectangle, polynomials and corners."""
    m = _xml(texts, ", ".join([_HEADER, _GENERAL, _IMAGE, _DOPPLER, _TIMING, _GRID]))
    c = F.col
    data = c("imageAnnotation.processingInformation.dcMethod") == "Data Analysis"
    m = m.select(
        *_common(m), c("adsHeader.swath").alias("swath"), c("swathTiming.linesPerBurst").alias("lines_per_burst"), c("swathTiming.samplesPerBurst").alias("samples_per_burst"),
        F.transform("generalAnnotation.azimuthFmRateList.azimuthFmRate", lambda a: seconds(a["azimuthTime"])).alias("az_fm_times"),
        F.transform("generalAnnotation.azimuthFmRateList.azimuthFmRate", lambda a: F.concat(F.array(a["t0"]), F.coalesce(numbers(a["azimuthFmRatePolynomial"]["_VALUE"]), F.array(a["c0"], a["c1"], a["c2"])))).alias("az_fm_info"),
        F.transform("dopplerCentroid.dcEstimateList.dcEstimate", lambda d: seconds(d["azimuthTime"])).alias("dc_estimate_time"),
        F.transform("dopplerCentroid.dcEstimateList.dcEstimate", lambda d: d["t0"]).alias("dc_estimate_t0"),
        F.transform("dopplerCentroid.dcEstimateList.dcEstimate", lambda d: numbers(F.when(data, d["dataDcPolynomial"]["_VALUE"]).otherwise(d["geometryDcPolynomial"]["_VALUE"]))).alias("dc_estimate_poly"),
        c("geolocationGrid.geolocationGridPointList.geolocationGridPoint").alias("gcp"), F.posexplode_outer("swathTiming.burstList.burst").alias("burst", "b"),
    ).where("burst is not null")  # products without bursts go here: asked for before, each text would be parsed again to count them
    left = F.expr("filter(transform(split(trim(b.firstValidSample._VALUE), '\\\\s+'), (v, j) -> struct(cast(v as int) as v, j as j)), p -> p.v >= 0)")
    right = F.expr("filter(transform(split(trim(b.lastValidSample._VALUE), '\\\\s+'), v -> cast(v as int)), v -> v >= 0)")
    m = m.withColumn("__l", left).withColumn("__r", right)
    first, last = F.get("__l", F.lit(0)), F.get("__l", F.size("__l") - 1)
    y, h = first["j"], last["j"] - first["j"] + 1
    start = seconds(c("b.azimuthTime"))
    begin = start + y / c("azimuth_frequency")
    # a burst's corners, around it: the least and largest pixel of its first line of tie points, the largest and least of the next one's
    lines = F.array_sort(F.array_distinct(F.transform("gcp", lambda g: g["line"])))
    m = m.withColumn("burst_times", F.struct(start.alias("start"), begin.alias("start_valid"), (begin + h / c("azimuth_frequency")).alias("end_valid")))
    m = m.withColumn("burst_roi", F.struct(first["v"].alias("col"), (y + c("burst") * c("lines_per_burst")).alias("row"), (F.get("__r", F.lit(0)) - first["v"] + 1).alias("w"), h.alias("h")))
    m = m.withColumn("__lines", lines)
    corner = F.expr("flatten(transform(array(struct(get(__lines, burst) as n, array(1, -1) as ends), struct(get(__lines, burst + 1) as n, array(-1, 1) as ends)), s -> transform(s.ends, e -> element_at(array_sort(transform(filter(gcp, g -> g.line = s.n), g -> struct(g.pixel, g.longitude, g.latitude, g.height))), e))))")
    m = m.withColumn("__corner", corner)
    m = m.withColumn("approx_geom", F.expr("transform(filter(__corner, q -> q is not null), q -> struct(q.longitude as lon, q.latitude as lat))")).withColumn("approx_altitude", F.expr("transform(filter(__corner, q -> q is not null), q -> q.height)"))
    return m.withColumn("azimuth_anx_time", c("b.azimuthAnxTime")).withColumn("burst_sensing_time", seconds(c("b.sensingTime"))).drop("b", "gcp", "__l", "__r", "__lines", "__corner")


def grd_products(texts: DataFrame) -> DataFrame:
    """One row a GRD annotation text, with the records of its ground-range conversion."""
    m = _xml(texts, ", ".join([_HEADER, _GENERAL, _IMAGE, _CONVERSION]))
    image, c = "imageAnnotation.imageInformation", F.col
    srgr = F.transform(
        "coordinateConversion.coordinateConversionList.coordinateConversion",
        lambda s: F.struct(seconds(s["azimuthTime"]).alias("time"), numbers(s["srgrCoefficients"]["_VALUE"]).alias("srgr"), numbers(s["grsrCoefficients"]["_VALUE"]).alias("grsr"), s["sr0"].alias("sr0"), s["gr0"].alias("gr0")),
    )
    return m.select(
        *_common(m), seconds(c(f"{image}.productFirstLineUtcTime")).alias("image_start"), seconds(c(f"{image}.productLastLineUtcTime")).alias("image_end"), c(f"{image}.azimuthTimeInterval").alias("azimuth_time_interval"),
        c(f"{image}.rangePixelSpacing").alias("range_pixel_spacing"), c(f"{image}.numberOfSamples").alias("width"), c(f"{image}.numberOfLines").alias("height"), srgr.alias("srgr"),
    )


def calibration_lut(texts: DataFrame, quantity: str = "sigmaNought") -> DataFrame:
    """path, line, pixel, value of calibration texts."""
    vector = f"calibrationVectorList struct<calibrationVector: array<struct<line: int, pixel: {VALUE}, {quantity}: {VALUE}>>>"
    v = _xml(texts, vector).select("path", F.explode("calibrationVectorList.calibrationVector").alias("v"))
    return _nodes(v, numbers(F.col("v.pixel._VALUE"), "int"), numbers(F.col(f"v.{quantity}._VALUE")))


def _nodes(v: DataFrame, pixels: Column, values: Column) -> DataFrame:
    pairs = v.select("path", F.col("v.line").alias("line"), F.explode(F.arrays_zip(pixels.alias("pixel"), values.alias("value"))).alias("n"))
    return pairs.select("path", "line", F.col("n.pixel").alias("pixel"), F.col("n.value").alias("value"))


def noise_lut(texts: DataFrame) -> DataFrame:
    """path, line, pixel, value of noise texts, of the range vectors or, in older products, the only ones."""
    both = ", ".join(f"{outer} struct<{inner}: array<struct<line: int, pixel: {VALUE}, {lut}: {VALUE}>>>" for outer, inner, lut in (("noiseRangeVectorList", "noiseRangeVector", "noiseRangeLut"), ("noiseVectorList", "noiseVector", "noiseLut")))
    m = _xml(texts, both)
    new = F.transform("noiseRangeVectorList.noiseRangeVector", lambda v: F.struct(v["line"].alias("line"), v["pixel"]["_VALUE"].alias("pixel"), v["noiseRangeLut"]["_VALUE"].alias("value")))
    old = F.transform("noiseVectorList.noiseVector", lambda v: F.struct(v["line"].alias("line"), v["pixel"]["_VALUE"].alias("pixel"), v["noiseLut"]["_VALUE"].alias("value")))
    v = m.select("path", F.explode(F.coalesce(new, old)).alias("v"))
    return _nodes(v, numbers(F.col("v.pixel"), "int"), numbers(F.col("v.value")))


def noise_azimuth_blocks(texts: DataFrame) -> DataFrame:
    """path, first and last line and sample, lines, values of the rectangles of azimuth noise; none in older products."""
    schema = f"noiseAzimuthVectorList struct<noiseAzimuthVector: array<struct<firstAzimuthLine: int, firstRangeSample: int, lastAzimuthLine: int, lastRangeSample: int, line: {VALUE}, noiseAzimuthLut: {VALUE}>>>"
    v = _xml(texts, schema).select("path", F.explode("noiseAzimuthVectorList.noiseAzimuthVector").alias("v"))
    return v.select(
        "path", F.col("v.firstAzimuthLine").alias("line0"), F.col("v.lastAzimuthLine").alias("line1"), F.col("v.firstRangeSample").alias("col0"), F.col("v.lastRangeSample").alias("col1"),
        numbers(F.col("v.line._VALUE"), "int").alias("lines"), numbers(F.col("v.noiseAzimuthLut._VALUE")).alias("values"),
    )


def manifest_links(texts: DataFrame) -> DataFrame:
    """path, position, href of the files a manifest lists, in its order."""
    links = F.expr("xpath(text, '//dataObject/byteStream/fileLocation/@href')")
    return texts.select("path", F.posexplode(links).alias("position", "href"))


def first_link(links: DataFrame, pattern: str) -> DataFrame:
    """path, href of the first listed file whose name matches."""
    return links.where(F.col("href").rlike(pattern)).groupBy("path").agg(F.min_by("href", "position").alias("href"))


def terrasar(texts: DataFrame) -> DataFrame:
    """One row a TerraSAR-X text."""
    schema = (
        "generalHeader struct<mission: string>, productInfo struct<imageDataInfo: struct<imageRaster: struct<numberOfRows: int, numberOfColumns: int, columnSpacing: struct<_VALUE: double>, rowSpacing: struct<_VALUE: double>>>,"
        " sceneInfo: struct<start: struct<timeUTC: string>, rangeTime: struct<firstPixel: double>>, missionInfo: struct<orbitDirection: string>, acquisitionInfo: struct<lookDirection: string>>,"
        " productSpecific struct<complexImageInfo: struct<projectedSpacingAzimuth: double, projectedSpacingRange: struct<slantRange: double>>>, instrument struct<radarParameters: struct<centerFrequency: double>>,"
        " platform struct<orbit: struct<stateVec: array<struct<timeUTC: string, posX: double, posY: double, posZ: double, velX: double, velY: double, velZ: double>>>>"
    )
    c, raster, scene, spacing = F.col, "productInfo.imageDataInfo.imageRaster", "productInfo.sceneInfo", "productSpecific.complexImageInfo"
    xyz = lambda s, kind: F.struct(*(s[f"{kind}{k}"].alias(k.lower()) for k in "XYZ"))
    states = F.transform("platform.orbit.stateVec", lambda s: F.named_struct(F.lit("time"), seconds(s["timeUTC"]), F.lit("position"), xyz(s, "pos"), F.lit("velocity"), xyz(s, "vel")))
    return _xml(texts, schema).select(
        "path", c("generalHeader.mission").alias("mission_id"), c(f"{raster}.numberOfRows").alias("height"), c(f"{raster}.numberOfColumns").alias("width"), seconds(c(f"{scene}.start.timeUTC")).alias("image_start"),
        c(f"{scene}.rangeTime.firstPixel").alias("slant_range_time"), c(f"{raster}.columnSpacing._VALUE").alias("azimuth_time_interval"), c(f"{raster}.rowSpacing._VALUE").alias("range_time_interval"),
        c(f"{spacing}.projectedSpacingAzimuth").alias("azimuth_pixel_spacing"), c(f"{spacing}.projectedSpacingRange.slantRange").alias("range_pixel_spacing"),
        (LIGHT_SPEED / c("instrument.radarParameters.centerFrequency")).alias("wavelength"), F.lower("productInfo.missionInfo.orbitDirection").alias("orbit_direction"),
        F.lower("productInfo.acquisitionInfo.lookDirection").alias("look_side"), states.alias("state_vectors"),
    )


ATTRIBUTE = r'<MDATTR\s[^>]*?name="([^"]*)"[^>]*?(?:/>|>([^<]*)</MDATTR>)'


def snap_attributes(texts: DataFrame) -> DataFrame:
    """path, name, value of the attributes of DIMAP texts."""
    # an attribute without text has no text node, so names and values are matched together
    parts = [F.regexp_extract_all("text", F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2)]
    listed = texts.select("path", F.explode(F.arrays_zip(parts[0].alias("name"), parts[1].alias("value"))).alias("z"))
    return listed.select("path", "z.name", F.nullif("z.value", F.lit("")).alias("value"))


def _element(depth: int) -> str:
    """Schema of a DIMAP element with elements nested so deep in it."""
    inner = f", MDElem: array<{_element(depth - 1)}>" if depth else ""
    return f"struct<_name: string, MDATTR: array<struct<_name: string, _VALUE: string>>{inner}>"


def snap_products(texts: DataFrame) -> DataFrame:
    """One row a product of DIMAP texts, the first of which is the primary: numbers, corners, state vectors, and the files of its real and imaginary band.

    What contradicts an unprojected, single-look complex product is listed in ``problems``; the row stays."""
    schema = (
        "Image_Interpretation struct<Spectral_Band_Info: array<struct<BAND_INDEX: int, BAND_NAME: string>>>, Data_Access struct<Data_File: array<struct<BAND_INDEX: int, DATA_FILE_PATH: struct<_href: string>>>>,"
        f" Dataset_Sources struct<MDElem: struct<MDElem: array<{_element(3)}>>>"
    )
    c = F.col
    named = lambda elements, name: F.filter(elements, lambda e: e["_name"] == name)
    product = lambda e: F.named_struct(F.lit("attrs"), e["MDATTR"], F.lit("vectors"), F.transform(F.flatten(F.transform(named(e["MDElem"], "Orbit_State_Vectors"), lambda o: o["MDElem"])), lambda v: v["MDATTR"]))
    top = c("Dataset_Sources.MDElem.MDElem")
    others = F.coalesce(F.flatten(F.transform(named(top, "Slave_Metadata"), lambda s: s["MDElem"])), F.array().cast(f"array<{_element(2)}>"))
    every = F.concat(F.transform(named(top, "Abstracted_Metadata"), product), F.transform(others, product))
    m = _xml(texts, schema).select("path", "Image_Interpretation", "Data_Access", F.posexplode(every).alias("product", "p"))
    of = lambda attrs, name: F.get(F.filter(attrs, lambda a: a["_name"] == name), F.lit(0))["_VALUE"]
    text = lambda name: of(c("p.attrs"), name)
    number = lambda name: text(name).try_cast("double")
    when = lambda v: F.unix_micros(F.coalesce(F.try_to_timestamp(v, F.lit("dd-MMM-yyyy HH:mm:ss[.SSSSSS]")), F.try_to_timestamp(v))) / 1e6
    xyz = lambda v, kind: F.named_struct(*(x for k in "xyz" for x in (F.lit(k), of(v, f"{k}_{kind}").try_cast("double"))))
    states = F.transform("p.vectors", lambda v: F.named_struct(F.lit("time"), when(of(v, "time")), F.lit("position"), xyz(v, "pos"), F.lit("velocity"), xyz(v, "vel")))
    corner = lambda where: F.struct(number(f"{where}_long").alias("lon"), number(f"{where}_lat").alias("lat"))
    bands = F.split(F.coalesce(text("Slave_bands"), F.lit("")), " ")
    index = lambda k: F.get(F.filter("Image_Interpretation.Spectral_Band_Info", lambda b: F.array_contains(bands, b["BAND_NAME"]) & b["BAND_NAME"].startswith(k)), F.lit(0))["BAND_INDEX"]
    file = lambda k: F.regexp_replace(F.get(F.filter("Data_Access.Data_File", lambda d: d["BAND_INDEX"] == index(k)), F.lit(0))["DATA_FILE_PATH"]["_href"], "[.]hdr$", ".img")
    checks = {
        "look side": text("antenna_pointing").isin("right", "left"), "orbit direction": text("PASS").isin("ASCENDING", "DESCENDING"), "sample type": text("SAMPLE_TYPE") == "COMPLEX",
        "looks": (number("azimuth_looks") == 1) & (number("range_looks") == 1), "terrain": number("is_terrain_corrected") == 0, "bands": file("i_").isNotNull() & file("q_").isNotNull(),
    }
    problems = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda p: p.isNotNull())
    return m.select(
        "path", "product", text("PRODUCT").alias("product_id"), F.lower(text("PASS")).alias("orbit_direction"), text("antenna_pointing").alias("look_side"), number("num_samples_per_line").cast("int").alias("width"),
        number("num_output_lines").cast("int").alias("height"), when(text("first_line_time")).alias("image_start"), when(text("last_line_time")).alias("image_stop"), (1 / number("line_time_interval")).alias("azimuth_frequency"),
        (2 * number("slant_range_to_first_pixel") / LIGHT_SPEED).alias("slant_range_time"), number("range_spacing").alias("range_pixel_spacing"), number("azimuth_spacing").alias("azimuth_pixel_spacing"),
        number("range_sampling_rate").alias("range_sampling_rate"), (LIGHT_SPEED / (number("radar_frequency") * 1e6)).alias("wavelength"), F.array(*map(corner, ("first_near", "first_far", "last_far", "last_near"))).alias("approx_geom"),
        states.alias("state_vectors"), file("i_").alias("real_file"), file("q_").alias("imaginary_file"), problems.alias("problems"),
    )


def complex_of_bands(real: DataFrame, imaginary: DataFrame, keep: list[str] = ()) -> DataFrame:
    """keep..., row, col, re, im of the pixels (keep..., row, col, value) that both bands have."""
    on = [*keep, "row", "col"]
    return real.select(*on, F.col("value").alias("re")).join(imaginary.select(*on, F.col("value").alias("im")), on)


def capella(texts: DataFrame) -> DataFrame:
    """One row a Capella JSON text; times are nanoseconds and, within the day of the start, seconds."""
    vector = "array<double>"
    poly = "struct<type: string, dimension: int, degree: string, coefficients: string>"
    schema = (
        "product_type string, collect struct<start_timestamp: string, stop_timestamp: string, radar: struct<center_frequency: double, transmit_polarization: string, receive_polarization: string, pointing: string>,"
        f" state: struct<direction: string, source: string, state_vectors: array<struct<time: string, position: {vector}, velocity: {vector}>>>,"
        " image: struct<rows: int, columns: int, pixel_spacing_row: double, pixel_spacing_column: double, range_resolution: double, ground_range_resolution: double, range_looks: double, azimuth_resolution: double, azimuth_looks: double,"
        f" scale_factor: double, center_pixel: struct<incidence_angle: double, target_position: {vector}>, frequency_doppler_centroid_polynomial: {poly},"
        " image_geometry: struct<type: string, range_to_first_sample: double, delta_range_sample: double, delta_line_time: double, first_line_time: string>, terrain_models: struct<reprojection: struct<name: string>>>>"
    )
    c = F.col
    m = texts.select("path", F.from_json("text", schema).alias("m")).select("path", c("m.product_type").alias("product_type"), "m.collect.*")
    start = nanoseconds(c("start_timestamp"))
    day = F.floor(start / 86_400_000_000_000) * 86_400_000_000_000
    since = lambda stamp: (nanoseconds(stamp) - day) / 1e9
    states = F.transform("state.state_vectors", lambda s: F.named_struct(F.lit("time"), since(s["time"]), F.lit("position"), s["position"], F.lit("velocity"), s["velocity"]))
    return m.select(
        "path", "product_type", start.alias("start_ns"), nanoseconds(c("stop_timestamp")).alias("stop_ns"), c("image.rows").alias("height"), c("image.columns").alias("width"), c("image.center_pixel.incidence_angle").alias("incidence"),
        c("image.pixel_spacing_column").alias("pixel_spacing_column"), c("image.pixel_spacing_row").alias("pixel_spacing_row"), c("image.range_resolution").alias("range_resolution"), c("image.azimuth_resolution").alias("azimuth_resolution"),
        c("image.scale_factor").alias("scale_factor"), (LIGHT_SPEED / c("radar.center_frequency")).alias("wavelength"), c("radar.transmit_polarization").alias("transmit_polarization"),
        c("radar.receive_polarization").alias("receive_polarization"), c("radar.pointing").alias("look_direction"), c("state.direction").alias("orbit_direction"), c("state.source").alias("state_vectors_origin"), states.alias("state_vectors"),
        c("image.image_geometry.range_to_first_sample").alias("starting_range"), c("image.image_geometry.delta_range_sample").alias("range_pixel_size"), c("image.image_geometry.delta_line_time").alias("delta_line_time"),
        since(c("image.image_geometry.first_line_time")).alias("first_line_time"), F.regexp_extract("image.terrain_models.reprojection.name", r"\[([^\]]+)\]", 1).try_cast("double").alias("inflation"),
    )
