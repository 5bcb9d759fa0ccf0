"""The resumable driver: stopped runs go on, failed dates are logged, nothing is made twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radarframe.operators import bursts, driver


def simple(spark, made, broken=(), said=()):
    def first(_, dates):
        made.append(("a", tuple(dates)))
        if set(dates) & set(broken):
            raise ValueError("no such product")
        return spark.createDataFrame([(d, k, "flag" if d in said else None) for d in dates for k in range(3)], "date string, v int, problem string")

    def second(tables, dates):
        made.append(("b", tuple(dates)))
        return tables["a"].groupBy("date").agg(F.sum("v").alias("v"))

    return [driver.Stage("a", first), driver.Stage("b", second, ("a",))]


def test_a_stopped_run_goes_on_without_repeating(spark, tmp_path):
    made = []
    run = driver.Run(spark, f"file://{tmp_path}/r", simple(spark, made))
    assert run.run(["d1", "d2"], until="a") == {} and run.table("b") is None
    again = driver.Run(spark, f"file://{tmp_path}/r", simple(spark, made))
    assert again.run(["d1", "d2", "d3"]) == {}
    assert made == [("a", ("d1", "d2")), ("a", ("d3",)), ("b", ("d1", "d2", "d3"))]
    assert {r.date: r.v for r in again.table("b").collect()} == {"d1": 3, "d2": 3, "d3": 3}
    again.run(["d1", "d2", "d3"])
    assert len(made) == 3


def test_rows_without_a_commit_are_not_read(spark, tmp_path):
    made = []
    run = driver.Run(spark, f"file://{tmp_path}/r", simple(spark, made))
    spark.createDataFrame([("d1", 99, None)], "date string, v int, problem string").write.parquet(f"file://{tmp_path}/r/a/left-over")
    run.run(["d1"])
    assert [r.v for r in run.table("b").collect()] == [3]


def test_failed_dates_are_logged_and_left_out(spark, tmp_path):
    made = []
    run = driver.Run(spark, f"file://{tmp_path}/r", simple(spark, made, broken=["d3"], said=["d5"]), primary="d1")
    failed = run.run([f"d{k}" for k in range(1, 7)])
    assert failed == {"d3": "a: no such product", "d5": "a: flag"}
    assert {r.date for r in run.table("b").collect()} == {"d1", "d2", "d4", "d6"}
    assert {tuple(r) for r in run.failures().collect()} == {("a", "d3", "no such product"), ("a", "d5", "flag")}
    with pytest.raises(RuntimeError, match="primary date d3"):
        driver.Run(spark, f"file://{tmp_path}/other", simple(spark, made, broken=["d3"]), primary="d3").run(["d2", "d3"])


def test_a_stack_from_matches_to_interferograms(spark, tmp_path):
    """Three dates shifted by whole pixels, one with too few matches: mosaics agree with the primary and interferograms are flat."""
    rng = np.random.default_rng(4)
    scene = rng.normal(size=(40, 20)) + 1j * rng.normal(size=(40, 20))
    cuts = bursts.cut(spark.createDataFrame([("p", "iw1", k, 0, k * 16, 16, 20, k * 16.0, k * 16.0 + 20) for k in range(2)], "acquisition string, swath string, burst int, col int, row int, w int, h int, start double, end double"), 1.0)
    moves = {"d1": (0, 0), "d2": (2, 1), "d3": (1, 3), "d4": (0, 0)}
    rows, places = [], []
    for d, (dy, dx) in moves.items():
        for b in range(2):
            rows += [(d, "iw1", b, r, q, float(scene[b * 16 + r - dy, q - dx].real), float(scene[b * 16 + r - dy, q - dx].imag)) for r in range(24 if b == 0 else 20) for q in range(20) if 0 <= b * 16 + r - dy < 40 and 0 <= q - dx < 20]
            places += [(d, "iw1", b, float(q), float(r), float(q + dx), float(r + dy)) for r in range(0, 20, 5) for q in range(0, 16, 5)][: 1 if d == "d4" else None]
    pixels = spark.createDataFrame(rows, "date string, swath string, burst int, row int, col int, re double, im double")
    matches = spark.createDataFrame(places, "date string, swath string, burst int, col double, row double, to_col double, to_row double")
    stages = driver.stack_stages(pixels, cuts, matches, "d1", (0, 2, 14, 30), (2, 2))
    run = driver.Run(spark, f"file://{tmp_path}/s", stages, "d1")
    assert run.run(["d1", "d2"], until="mosaic") == {}
    failed = driver.Run(spark, f"file://{tmp_path}/s", stages, "d1").run(["d1", "d2", "d3", "d4"])
    assert set(failed) == {"d4"} and failed["d4"].startswith("maps")
    mosaic = run.table("mosaic").toPandas()
    assert mosaic.groupby("date").size().to_dict() == {d: 14 * 30 for d in ("d1", "d2", "d3")}
    inner = mosaic.dropna()
    assert np.allclose(inner["re"], scene.real[inner["row"] + 2, inner["col"]], atol=1e-6) and len(inner) > 1000
    i = run.table("interferogram").toPandas().dropna()
    assert {"d2", "d3"} <= set(i["date"]) and np.abs(i["im"]).max() < 1e-6 and i["coherence"].min() > 0.999
