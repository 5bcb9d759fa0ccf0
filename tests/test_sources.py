"""Metadata parsers on small authored texts."""

import pytest
from pyspark.sql import functions as F

from radarframe.sources import metadata as md

ORBIT = """<?xml version="1.0"?><Earth_Explorer_File><Earth_Explorer_Header/><Data_Block type="xml"><List_of_OSVs count="3">{}</List_of_OSVs></Data_Block></Earth_Explorer_File>""".format(
    "".join(
        f'<OSV><TAI>TAI=x</TAI><UTC>UTC=2021-01-01T00:00:{s:02d}.500000</UTC><Absolute_Orbit>+3</Absolute_Orbit><X unit="m">{s}.25</X><Y unit="m">-2</Y><Z unit="m">3</Z><VX unit="m/s">4</VX><VY unit="m/s">5</VY><VZ unit="m/s">{-s}</VZ></OSV>'
        for s in (0, 10, 20)
    )
)
BURST = '<burst><azimuthTime>2021-01-01T00:00:0{k}.000000</azimuthTime><azimuthAnxTime>{k}.5</azimuthAnxTime><sensingTime>2021-01-01T00:00:0{k}.250000</sensingTime><firstValidSample count="5">-1 7 7 7 -1</firstValidSample><lastValidSample count="5">-1 90 90 90 -1</lastValidSample></burst>'
COMMON = """<adsHeader><missionId>S1B</missionId><absoluteOrbitNumber>30</absoluteOrbitNumber><swath>IW2</swath></adsHeader>
<generalAnnotation><productInformation><pass>Ascending</pass><rangeSamplingRate>6.4e+07</rangeSamplingRate><radarFrequency>5.4e+09</radarFrequency><azimuthSteeringRate>1.5</azimuthSteeringRate></productInformation>
<orbitList count="1"><orbit><time>2021-01-01T00:00:00.000000</time><position><x>1</x><y>2</y><z>3</z></position><velocity><x>4</x><y>5</y><z>6</z></velocity></orbit></orbitList>
<azimuthFmRateList count="2"><azimuthFmRate><azimuthTime>2021-01-01T00:00:00.000000</azimuthTime><t0>0.005</t0><azimuthFmRatePolynomial count="3">-2.3e3 4 5</azimuthFmRatePolynomial></azimuthFmRate>
<azimuthFmRate><azimuthTime>2021-01-01T00:00:01.000000</azimuthTime><t0>0.006</t0><c0>1</c0><c1>2</c1><c2>3</c2></azimuthFmRate></azimuthFmRateList></generalAnnotation>
<imageAnnotation><imageInformation><azimuthFrequency>2</azimuthFrequency><slantRangeTime>0.0053</slantRangeTime><ascendingNodeTime>2020-12-31T23:59:00.000000</ascendingNodeTime><sliceNumber>4</sliceNumber><sliceList count="9"/>
<productFirstLineUtcTime>2021-01-01T00:00:00.000000</productFirstLineUtcTime><productLastLineUtcTime>2021-01-01T00:00:25.000000</productLastLineUtcTime><azimuthTimeInterval>0.0015</azimuthTimeInterval><rangePixelSpacing>10</rangePixelSpacing>
<numberOfSamples>100</numberOfSamples><numberOfLines>200</numberOfLines></imageInformation><processingInformation><dcMethod>{dc}</dcMethod></processingInformation></imageAnnotation>"""
SLC = (
    '<?xml version="1.0"?><product>' + COMMON.format(dc="Data Analysis") + '<dopplerCentroid><dcEstimateList count="1"><dcEstimate><azimuthTime>2021-01-01T00:00:00.000000</azimuthTime><t0>0.004</t0><geometryDcPolynomial count="2">9 9</geometryDcPolynomial>'
    '<dataDcPolynomial count="2">1.5 2</dataDcPolynomial></dcEstimate></dcEstimateList></dopplerCentroid><swathTiming><linesPerBurst>5</linesPerBurst><samplesPerBurst>100</samplesPerBurst><burstList count="2">' + BURST.format(k=1) + BURST.format(k=4)
    + "</burstList></swathTiming><geolocationGrid><geolocationGridPointList>"
    + "".join(f"<geolocationGridPoint><line>{n}</line><pixel>{p}</pixel><longitude>{n + p / 100}</longitude><latitude>{n}</latitude><height>{n + p}</height></geolocationGridPoint>" for n in (0, 5, 10) for p in (0, 50, 99))
    + "</geolocationGridPointList></geolocationGrid></product>"
)
GRD = '<product>' + COMMON.format(dc="x") + "<coordinateConversion><coordinateConversionList>" + "".join(
    f'<coordinateConversion><azimuthTime>2021-01-01T00:00:0{k}.000000</azimuthTime><sr0>{k}</sr0><srgrCoefficients count="2">1 {k}</srgrCoefficients><gr0>0</gr0><grsrCoefficients count="2">3 4</grsrCoefficients></coordinateConversion>' for k in (0, 1)
) + "</coordinateConversionList></coordinateConversion></product>"
T0 = 1609459200.0


def texts(spark, *t):
    return spark.createDataFrame([(f"p{k}", x) for k, x in enumerate(t)], "path string, text string")


def test_orbit_span_includes_both_ends(spark):
    t = texts(spark, ORBIT, "not xml", None)
    got = md.orbit_states(t, T0 + 0.5, T0 + 10.5).orderBy("t").collect()
    assert [(r.path, r.t, r.x, r.vz) for r in got] == [("p0", T0 + 0.5, 0.25, 0.0), ("p0", T0 + 10.5, 10.25, -10.0)]


def test_numbers_of_orbit_files(spark):
    """Comments, blanks and references inside a number, and elements that hold none; the others of the file stay."""
    cases = {'<X unit="m">1<!-- c -->25.5</X>': 125.5, "<X> 1.25\n</X>": 1.25, '<X unit="m">1&#46;5</X>': 1.5, "<X><![CDATA[-2e3]]></X>": -2000.0, '<X unit="m">1<q>7</q></X>': None, '<X unit="m">abc</X>': None, '<X unit="m"/>': None, "": None}
    osv = "".join(f"<OSV><UTC>UTC=2021-01-01T00:00:{k:02d}.5</UTC>{x}<VZ>{k}</VZ></OSV>" for k, x in enumerate(cases))
    got = md.orbit_states(texts(spark, f"<F><Data_Block><List_of_OSVs>{osv}</List_of_OSVs></Data_Block></F>")).orderBy("t").collect()
    assert [(r.t, r.x, r.y, r.vz) for r in got] == [(T0 + k + 0.5, x, None, float(k)) for k, x in enumerate(cases.values())]


def test_bursts(spark):
    a, b = md.slc_bursts(texts(spark, SLC)).orderBy("burst").collect()
    assert (a.mission_id, a.relative_orbit_number, a.swath, a.slice_number, a.slice_count, a.lines_per_burst) == ("S1B", 4, "IW2", 4, 9, 5)
    assert tuple(a.burst_roi) == (7, 1, 84, 3) and tuple(b.burst_roi) == (7, 6, 84, 3)
    assert tuple(b.burst_times) == (T0 + 4, T0 + 4.5, T0 + 6)
    assert a.az_fm_info == [[0.005, -2300.0, 4.0, 5.0], [0.006, 1.0, 2.0, 3.0]]
    assert a.dc_estimate_poly == [[1.5, 2.0]] and a.anx_time == T0 - 60 and a.state_vectors[0].velocity.z == 6
    assert [tuple(g) for g in b.approx_geom] == [(5.0, 5.0), (5.99, 5.0), (10.99, 10.0), (10.0, 10.0)]
    assert b.approx_altitude == [5.0, 104.0, 109.0, 10.0]
    assert b.burst_sensing_time == T0 + 4.25 and b.azimuth_anx_time == 4.5


def test_ground_range_products(spark):
    r = md.grd_products(texts(spark, GRD)).first()
    assert (r.width, r.height, r.image_end, r.range_pixel_spacing) == (100, 200, T0 + 25, 10.0)
    assert [(s.time, s.srgr, s.grsr, s.sr0) for s in r.srgr] == [(T0, [1.0, 0.0], [3.0, 4.0], 0.0), (T0 + 1, [1.0, 1.0], [3.0, 4.0], 1.0)]


def test_lookup_tables(spark):
    cal = '<calibration><calibrationVectorList count="1"><calibrationVector><line>-3</line><pixel count="3">0 40 80</pixel><sigmaNought count="3">1.5 2 3e2</sigmaNought></calibrationVector></calibrationVectorList></calibration>'
    assert [tuple(r)[1:] for r in md.calibration_lut(texts(spark, cal)).collect()] == [(-3, 0, 1.5), (-3, 40, 2.0), (-3, 80, 300.0)]
    new = (
        '<noise><noiseRangeVectorList><noiseRangeVector><line>0</line><pixel count="2">0 9</pixel><noiseRangeLut count="2">5 6</noiseRangeLut></noiseRangeVector></noiseRangeVectorList>'
        '<noiseAzimuthVectorList count="1"><noiseAzimuthVector><firstAzimuthLine>0</firstAzimuthLine><firstRangeSample>1</firstRangeSample><lastAzimuthLine>7</lastAzimuthLine><lastRangeSample>9</lastRangeSample><line count="2">0 7</line><noiseAzimuthLut count="2">1 0.5</noiseAzimuthLut></noiseAzimuthVector></noiseAzimuthVectorList></noise>'
    )
    old = '<noise><noiseVectorList><noiseVector><line>2</line><pixel count="1">4</pixel><noiseLut count="1">8</noiseLut></noiseVector></noiseVectorList></noise>'
    t = texts(spark, new, old)
    assert {tuple(r) for r in md.noise_lut(t).collect()} == {("p0", 0, 0, 5.0), ("p0", 0, 9, 6.0), ("p1", 2, 4, 8.0)}
    assert [tuple(r) for r in md.noise_azimuth_blocks(t).collect()] == [("p0", 0, 7, 1, 9, [0, 7], [1.0, 0.5])]


def test_manifest_order(spark):
    links = ["./annotation/s1-iw1-vv.xml", "./measurement/s1-iw1-vv.tiff", "./annotation/s1-iw2-vv.xml"]
    xml = "<XFDU><dataObjectSection>" + "".join(f'<dataObject><byteStream><fileLocation locatorType="URL" href="{x}"/></byteStream></dataObject>' for x in links) + "</dataObjectSection></XFDU>"
    got = md.manifest_links(texts(spark, xml))
    assert [r.href for r in got.orderBy("position").collect()] == links
    assert md.first_link(got, "annotation/.*vv").first().href == links[0]


def test_other_sensors(spark):
    tsx = """<level1Product><generalHeader><mission>TSX-1</mission></generalHeader><productInfo><imageDataInfo><imageRaster><numberOfRows>10</numberOfRows><numberOfColumns>20</numberOfColumns><columnSpacing units="s">0.5</columnSpacing><rowSpacing units="s">0.25</rowSpacing></imageRaster></imageDataInfo>
    <sceneInfo><start><timeUTC>2021-01-01T00:00:01.000000Z</timeUTC></start><rangeTime><firstPixel>0.004</firstPixel></rangeTime></sceneInfo><missionInfo><orbitDirection>ASCENDING</orbitDirection></missionInfo><acquisitionInfo><lookDirection>RIGHT</lookDirection></acquisitionInfo></productInfo>
    <productSpecific><complexImageInfo><projectedSpacingAzimuth>2</projectedSpacingAzimuth><projectedSpacingRange><slantRange>1</slantRange></projectedSpacingRange></complexImageInfo></productSpecific><instrument><radarParameters><centerFrequency>9.65e9</centerFrequency></radarParameters></instrument>
    <platform><orbit><stateVec num="1"><timeUTC>2021-01-01T00:00:00.000000</timeUTC><posX>1</posX><posY>2</posY><posZ>3</posZ><velX>4</velX><velY>5</velY><velZ>6</velZ></stateVec></orbit></platform></level1Product>"""
    r = md.terrasar(texts(spark, tsx)).first()
    assert (r.mission_id, r.height, r.width, r.image_start, r.azimuth_time_interval, r.orbit_direction, r.look_side) == ("TSX-1", 10, 20, T0 + 1, 0.5, "ascending", "right")
    assert r.state_vectors[0].position.y == 2 and r.wavelength == pytest.approx(0.03106657)
    snap = '<Dimap><MDElem name="m"><MDATTR name="PRODUCT" type="ascii">abc</MDATTR><MDATTR name="empty" type="ascii"/><MDATTR name="n" type="int32">5</MDATTR></MDElem></Dimap>'
    assert [tuple(r)[1:] for r in md.snap_attributes(texts(spark, snap)).collect()] == [("PRODUCT", "abc"), ("empty", None), ("n", "5")]
    cap = '{"product_type": "SLC", "collect": {"start_timestamp": "2021-01-01T00:00:01.123456789Z", "stop_timestamp": "2021-01-01T00:00:02Z", "radar": {"center_frequency": 9.65e9, "transmit_polarization": "H", "receive_polarization": "V", "pointing": "left"}, "state": {"direction": "ascending", "source": "precise", "state_vectors": [{"time": "2021-01-01T00:00:00.5Z", "position": [1, 2, 3], "velocity": [4, 5, 6]}]}, "image": {"rows": 3, "columns": 4, "image_geometry": {"type": "slant_plane", "range_to_first_sample": 7e5, "delta_line_time": 0.1, "first_line_time": "2021-01-01T00:00:01.25Z"}, "terrain_models": {"reprojection": {"name": "ExplicitInflatedWGS84[123.5]"}}}}}'
    r = md.capella(texts(spark, cap, "{")).orderBy("path").first()
    assert (r.start_ns, r.stop_ns, r.height, r.look_direction) == (int(T0) * 10**9 + 1123456789, int(T0 + 2) * 10**9, 3, "left")
    assert (r.first_line_time, r.inflation, r.state_vectors[0].time, r.state_vectors[0].velocity) == (1.25, 123.5, 0.5, [4.0, 5.0, 6.0])


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.EOF").write_text(ORBIT)
    assert md.orbit_states(md.read_texts(spark, str(tmp_path / "a.EOF"))).count() == 3


def test_raster_windows_read_only_their_tiles(spark, tmp_path):

    from radarframe.sources import tiles

    df = spark.range(40 * 50).select((F.col("id") / 50).cast("long").alias("row"), (F.col("id") % 50).alias("col"), F.col("id").cast("double").alias("v"))
    path = f"file://{tmp_path}/raster"
    tiles.write(df, path, 16)
    got = tiles.window(spark, path, 10, 20, 30, 8)
    assert {(r.row, r.col, r.v) for r in got.collect()} == {(r, c, r * 50.0 + c) for r in range(20, 28) for c in range(10, 40)}
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(tile_row" in plan and "GreaterThanOrEqual(col,10)" in plan
    edge = tiles.window(spark, path, 45, 38, 10, 4, boundless=True).collect()
    assert len(edge) == 40 and sum(r.v is not None for r in edge) == 10


def test_catalogue_search(spark):
    from radarframe.sources import catalog

    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    rows = [(f"n{k}", "SLC", float(k), float(k + 2), 7, "VV" if k % 2 else "VV VH", square(float(k)), k != 3) for k in range(8)]
    items = spark.createDataFrame(rows, "name string, product_type string, start double, stop double, relative_orbit int, polarisation string, footprint array<struct<lon: double, lat: double>>, online boolean")
    find = lambda **how: [r.name for r in catalog.search(items, 0.0, 100.0, product_type="SLC", **how).collect()]
    assert find() == ["n1", "n2", "n4", "n5", "n6", "n7"]
    assert find(relative_orbit=8) == [] and find(polarisations=["VV VH"]) == ["n2", "n4", "n6"] and find(limit=2) == ["n1", "n2"]
    assert find(area=[(4.5, 0.5), (5.5, 0.2), (5.5, 0.8)]) == ["n4", "n5"]
    assert find(area=[(-9.0, -9.0), (5.2, -9.0), (5.2, 9.0), (-9.0, 9.0)]) == ["n1", "n2", "n4", "n5"]
    assert catalog.lookup(items, "n3").count() == 1


def _dimap(name, second="", **change):
    given = dict(
        PRODUCT=name, antenna_pointing="right", PASS="ASCENDING", SAMPLE_TYPE="COMPLEX", azimuth_looks="1.0", range_looks="1.0", range_spacing="2.5", azimuth_spacing="3", radar_frequency="5405.0", line_time_interval="0.002",
        num_output_lines="200", num_samples_per_line="100", is_terrain_corrected="0", slant_range_to_first_pixel="800000", range_sampling_rate="64", first_line_time="14-FEB-2020 05:26:38.250000", last_line_time="14-FEB-2020 05:26:39.000000",
        Slave_bands=f"i_{name} q_{name}", **{f"{a}_{b}_{c}": f"{k}" for k, (a, b, c) in enumerate((a, b, c) for a in ("first", "last") for b in ("near", "far") for c in ("lat", "long"))},
    ) | change
    vectors = "".join(f'<MDElem name="orbit_vector{k}"><MDATTR name="time">14-FEB-2020 05:26:{30 + 10 * k}.000000</MDATTR>' + "".join(f'<MDATTR name="{a}_{b}">{k}.5</MDATTR>' for a in "xyz" for b in ("pos", "vel")) + "</MDElem>" for k in range(2))
    return "".join(f'<MDATTR name="{k}" type="ascii">{v}</MDATTR>' for k, v in given.items()) + f'<MDElem name="Orbit_State_Vectors">{vectors}</MDElem>{second}'


def test_dimap_products_and_their_bands(spark):
    bands = "".join(f"<Spectral_Band_Info><BAND_INDEX>{k}</BAND_INDEX><BAND_NAME>{n}</BAND_NAME></Spectral_Band_Info>" for k, n in enumerate(("i_a", "q_a", "i_b", "q_b")))
    files = "".join(f'<Data_File><DATA_FILE_PATH href="x.data/{n}.hdr"/><BAND_INDEX>{k}</BAND_INDEX></Data_File>' for k, n in enumerate(("i_a", "q_a", "i_b", "q_b")))
    sources = f'<MDElem name="metadata"><MDElem name="Abstracted_Metadata">{_dimap("a")}</MDElem><MDElem name="Slave_Metadata"><MDElem name="b_1">{_dimap("b", look="x", antenna_pointing="up", azimuth_looks="4")}</MDElem></MDElem></MDElem>'
    text = f"<Dimap_Document><Image_Interpretation>{bands}</Image_Interpretation><Data_Access>{files}</Data_Access><Dataset_Sources>{sources}</Dataset_Sources></Dimap_Document>"
    a, b = md.snap_products(texts(spark, text, "no xml", None)).orderBy("product").collect()
    assert (a.product_id, a.width, a.height, a.azimuth_frequency, a.orbit_direction, a.problems) == ("a", 100, 200, 500.0, "ascending", [])
    assert a.image_start == 1581657998.25 and (a.real_file, a.imaginary_file) == ("x.data/i_a.img", "x.data/q_a.img") and (b.real_file, b.imaginary_file) == ("x.data/i_b.img", "x.data/q_b.img")
    assert [s.time - 1581657990 for s in a.state_vectors] == [0, 10] and a.state_vectors[1].position.z == 1.5 and b.state_vectors[0].velocity.x == 0.5
    assert tuple(a.approx_geom[0]) == (1.0, 0.0) and a.slant_range_time == pytest.approx(2 * 8e5 / 299792458) and sorted(b.problems) == ["look side", "looks"]
    from radarframe.operators import models

    m = models.of_snap(md.snap_products(texts(spark, text))).orderBy("product").first()
    assert m.product == "p0#0" and m.model.range_step == 2.5 and m.model.right and m.model.first_rng == pytest.approx(8e5)
    i = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, value double")
    assert [tuple(r) for r in md.complex_of_bands(i, i.where("col = 1").withColumn("value", F.lit(5.0))).collect()] == [(0, 1, 2.0, 5.0)]
