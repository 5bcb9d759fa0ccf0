"""COSMO-SkyMed and NISAR metadata from authored tables of tags and datasets."""

import pytest
from pyspark.sql import functions as F

from radarframe.sources import hdf5meta

TAGS = {
    "Mission_ID": "CSK", "Reference_UTC": "2020-03-01 00:00:00.000000000", "S01_SBI_Zero_Doppler_Azimuth_First_Time": "100.5", "S01_SBI_Line_Time_Interval": "0.0005", "S01_SBI_Zero_Doppler_Range_First_Time": "0.0045",
    "S01_SBI_Column_Spacing": "1.5", "S01_SBI_Line_Spacing": "2.5", "AZIMUTH_PIXEL_SPACING": "2.25", "Radar_Wavelength": "0.0312", "S01_Sampling_Rate": "112500000", "Light_Speed": "299792458", "Orbit_Direction": "ASCENDING", "Look_Side": "RIGHT",
    "State_Vectors_Times": "0 10", "ECEF_Satellite_Position": "1 2 3 4 5 6", "ECEF_Satellite_Velocity": "7 8 9 10 11 12", "Centroid_vs_Range_Time_Polynomial": "-100.5 0 0",
    "S01_SBI_Top_Left_Geodetic_Coordinates": "45 7 100", "S01_SBI_Top_Right_Geodetic_Coordinates": "45 8 100", "S01_SBI_Bottom_Right_Geodetic_Coordinates": "44 8 100", "S01_SBI_Bottom_Left_Geodetic_Coordinates": "44 7 100",
}


def test_cosmo_reads_both_generations_and_lists_problems(spark):
    second = {k.replace("_SBI_", "_IMG_"): v for k, v in TAGS.items()} | {"Mission_ID": "CSG"}
    rows = [("a", TAGS, 10, 20), ("b", second, 10, 20), ("c", TAGS | {"Light_Speed": "3e8", "Look_Side": "up"}, 1, 1), ("d", {}, 1, 1), ("e", None, None, None)]
    got = {r["path"]: r for r in hdf5meta.cosmo(spark.createDataFrame(rows, "path string, tags map<string,string>, width int, height int")).collect()}
    a = got["a"]
    assert a["problems"] == [] and got["b"]["problems"] == [] and set(got["c"]["problems"]) == {"light speed", "look side"} and len(got["d"]["problems"]) == 5 and len(got["e"]["problems"]) == 5
    assert a["image_start"] == 1583020800 + 100.5 and a["azimuth_frequency"] == pytest.approx(2000) and a["range_pixel_spacing"] == 1.5 and a["azimuth_pixel_spacing"] == 2.25
    assert [s["time"] - 1583020800 for s in a["state_vectors"]] == [0, 10] and a["state_vectors"][1]["position"] == [4, 5, 6] and a["state_vectors"][1]["velocity"] == [10, 11, 12]
    assert [tuple(p) for p in a["approx_geom"]] == [(7, 45), (8, 45), (8, 44), (7, 44)] and a["doppler_coefficients"] == [-100.5, 0, 0]
    assert a["slant_range_time"] == got["b"]["slant_range_time"] == 0.0045


def _nisar(path, b=False, frame=12.0, since="2025-01-02T00:00:00.000000000"):
    unit = f"seconds since {since}"
    one = lambda name, numbers=None, texts=None, units=None: (path, f"science/LSAR/{name}", numbers and [float(v) for v in numbers], texts, units)
    rows = [one(f"identification/{k}", texts=[v]) for k, v in (("missionId", "NISAR"), ("granuleId", "G1"), ("orbitPassDirection", "Ascending"), ("lookDirection", "Left"), ("zeroDopplerStartTime", "2025-01-02T00:01:40.500000000"), ("boundingPolygon", "POLYGON ((1 2 0, 3 2.5 0, 1 2 0))"))]
    rows += [one(f"identification/{k}", [v]) for k, v in (("absoluteOrbitNumber", 1000.0), ("trackNumber", 17.0), ("frameNumber", frame))]
    rows += [one("identification/listOfFrequencies", texts=["A", "B"] if b else ["A"]), one("RSLC/swaths/zeroDopplerTime", [100.5, 100.6, 100.7], units=unit), one("RSLC/swaths/zeroDopplerTimeSpacing", [0.1])]
    for f in "AB" if b else "A":
        g = f"RSLC/swaths/frequency{f}"
        rows += [one(f"{g}/slantRange", [9e5, 9e5 + 6]), one(f"{g}/listOfPolarizations", texts=["HH", "HV"])]
        rows += [one(f"{g}/{k}", [v]) for k, v in (("slantRangeSpacing", 6.0), ("sceneCenterGroundRangeSpacing", 9.0), ("sceneCenterAlongTrackSpacing", 4.0), ("acquiredCenterFrequency", 1.2e9), ("processedCenterFrequency", 1.25e9))]
        n = f"RSLC/metadata/calibrationInformation/frequency{f}/{'nes0' if f == 'A' else 'noiseEquivalentBackscatter'}"
        rows += [one(f"{n}/zeroDopplerTime", [100.0], units=unit), one(f"{n}/slantRange", [9e5]), one(f"{n}/HH", [0.001])]
    rows += [one("RSLC/metadata/orbit/time", [0.0, 10.0], units=unit), one("RSLC/metadata/orbit/position", [1.0, 2, 3, 4, 5, 6]), one("RSLC/metadata/orbit/velocity", [7.0, 8, 9, 10, 11, 12])]
    rows += [one("RSLC/metadata/geolocationGrid/zeroDopplerTime", [1.0], units=unit), one("RSLC/metadata/geolocationGrid/epsg", [4326.0]), one("RSLC/metadata/calibrationInformation/geometry/zeroDopplerTime", [1.0], units=unit), one("RSLC/metadata/calibrationInformation/geometry/beta0", [2.0])]
    return rows


def test_nisar_reads_frequencies_and_lists_problems(spark):
    rows = _nisar("a") + _nisar("b", b=True) + _nisar("c", frame=400.0, since="2025-01-01T00:00:00.000000000")
    df = spark.createDataFrame(rows, "path string, name string, numbers array<double>, texts array<string>, units string").repartition(3)
    got = {r["path"]: r for r in hdf5meta.nisar(df).collect()}
    a, b = got["a"], got["b"]
    assert a["problems"] == [] and b["problems"] == [] and set(got["c"]["problems"]) == {"frame", "first line"}
    assert a["radar_band"] == "L" and a["frequency_b"] is None and b["frequency_b"]["ne_backscatter_dataset"] == "noiseEquivalentBackscatter"
    assert a["frequency_a"]["width"] == 2 and a["frequency_a"]["wavelength"] == pytest.approx(0.239833966) and a["frequency_a"]["ne_backscatter"] == {"HH": [0.001]}
    assert a["height"] == 3 and a["state_vectors"][0]["velocity"] == [7, 8, 9] and [tuple(p) for p in a["approx_geom"]] == [(1, 2), (3, 2.5), (1, 2)]
    assert a["ref_timestamp"] == 1735776000 and a["lut_beta0"] == [2.0] and a["gcps_epsg"] == 4326
    assert hdf5meta.nisar(df.where(F.lit(False))).count() == 0
