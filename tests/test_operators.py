"""Invariants of the operators on small synthetic inputs."""

import math

from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import joins, network, psi, raster


def test_wrap_is_congruent_and_in_range(spark):
    df = spark.range(-200, 200).select((F.col("id") * 0.1).alias("x")).withColumn("w", phase.wrap(F.col("x")))
    for r in df.collect():
        assert -math.pi <= r.w < math.pi
        assert abs(math.remainder(r.w - r.x, 2 * math.pi)) < 1e-9


def test_ramp_unwraps_to_itself(spark):
    p = spark.range(50 * 20).select((F.col("id") / 20).cast("long").alias("row"), (F.col("id") % 20).alias("col"))
    p = p.withColumn("true", F.col("row") * 2.0 + F.col("col") * 1.5).withColumn("phi", phase.wrap(F.col("true")))
    off = raster.integrated(p, phase.wrap).select((F.col("unwrapped") - F.col("true")).alias("d")).collect()
    assert max(abs(r.d - off[0].d) for r in off) < 1e-9
    assert raster.residues(p, phase.wrap).where("residue <> 0").count() == 0


def test_constant_field_has_coherent_box(spark):
    p = spark.range(100).select((F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"), F.lit(2.0).alias("v"))
    assert {r.mean_v for r in raster.box_mean(p, ["v"], 1, 1).collect()} == {2.0}


def test_periodogram_finds_the_simulated_rates(spark):
    rows = [(ps, math.remainder(0.3 * t - 0.2 * ((t * 7) % 5), 2 * math.pi), float(t), float((t * 7) % 5)) for ps in range(3) for t in range(20)]
    series = spark.createDataFrame(rows, "ps long, phi double, t double, b double")
    axis = [round(-0.5 + 0.1 * k, 1) for k in range(11)]
    for r in psi.periodogram(series, {"v": "t", "q": "b"}, psi.grid(spark, {"v": axis, "q": axis})).collect():
        assert (r.v, r.q, r.n) == (0.3, -0.2, 20)
        assert r.gamma > 0.999


def test_containment_is_strict(spark):
    s = spark.createDataFrame([(1, 2.0)], "seg long, s_start double").withColumn("s_end", F.col("s_start") + 0.5)
    f = spark.createDataFrame([(1, 2.0, 3.0), (2, 1.9, 2.5), (3, 1.0, 4.0)], "fid long, f_start double, f_end double")
    assert [r.fid for r in joins.containment_join(s, f).collect()] == [3]


def test_best_containing_file_equals_brute_force(spark):
    segs = [(k, k * 0.37, k * 0.37 + 0.05 * (k % 3)) for k in range(60)]
    files = [(k, (k * 0.731) % 23 - 1, (k * 0.731) % 23 - 1 + 0.4 + (k * 0.17) % 3) for k in range(80)]
    files += [(80, 2 * 0.37, 9.0), (81, 1.0, 10 * 0.37 + 0.05)]  # touch a segment's start and end
    s, f = spark.createDataFrame(segs, "seg long, s_start double, s_end double"), spark.createDataFrame(files, "fid long, f_start double, f_end double")
    for width in (0.25, 1.0, 7.0):
        got = {r.seg: r.best.k for r in joins.best_containing(s, f, F.struct((-F.col("fid")).alias("k")), 0.1, width).collect()}
        want = {seg: -max(hits) for seg, a, b in segs if (hits := [k for k, x, y in files if x < a and y > b])}
        assert got == want


def test_distance_join_equals_brute_force(spark):
    pts = [(k, (k * 37 % 101) / 3, (k * 53 % 97) / 3) for k in range(150)]
    got = {(r.a, r.b) for r in joins.within_distance(spark.createDataFrame(pts, "id long, x double, y double"), 4.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and math.dist(a[1:], b[1:]) < 4.0}


def test_components_of_a_long_chain(spark):
    v = spark.range(60)
    e = spark.createDataFrame([(k, k + 1) for k in range(59) if k != 30], "a long, b long")
    got = {r.id: r.component for r in network.components(v, e, lambda d: spark.createDataFrame(d.collect(), d.schema)).collect()}
    assert got == {k: 0 if k <= 30 else 31 for k in range(60)}


def test_best_containing_against_brute_force(spark):
    import random

    from radarframe.operators import joins

    rng = random.Random(1)
    files = [(k, a := rng.uniform(-50, 50), a + rng.choice([0.01, 0.3, 1, 5, 40]) * rng.random()) for k in range(400)]
    segments = [(k, a := rng.uniform(-50, 50), a + rng.random() * 0.2) for k in range(600)]
    f, s = spark.createDataFrame(files, "fid long, f_start double, f_end double"), spark.createDataFrame(segments, "seg long, s_start double, s_end double")
    got = {r.seg: r.best.fid for r in joins.best_containing(s, f, F.struct("fid"), 0.2, 0.125).collect()}
    holding = {k: [i for i, x, y in files if x < a and y > b] for k, a, b in segments}
    assert got == {k: min(v) for k, v in holding.items() if v}
    assert joins.best_containing(s, f.where("false"), F.struct("fid"), 0.2, 0.125).count() == 0


def test_percentiles_are_exact(spark):
    import numpy as np

    from radarframe.operators import images

    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3000), rng.integers(0, 4, 2000).astype(float), np.array([7.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        got = images.percentiles(df, "v", [0.0, 0.02, 0.5, 0.98, 1.0], bins=64)
        assert np.allclose(got, np.quantile(values, [0.0, 0.02, 0.5, 0.98, 1.0]))
    assert images.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_percentiles_are_narrowed_until_few_values_are_left(spark, monkeypatch):
    import numpy as np

    from radarframe.operators import images

    monkeypatch.setattr(images, "FEW_VALUES", 20)
    values = np.concatenate([np.random.default_rng(5).normal(size=4000), np.full(3000, 0.25)])
    got = images.percentiles(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", [0.1, 0.5, 0.6, 0.999], bins=50)
    assert np.allclose(got, np.quantile(values, [0.1, 0.5, 0.6, 0.999]))


def test_merged_slices_keep_each_vector_once(spark):
    from radarframe.operators import series

    rows = [(1, 10, 5, 0.0, 1.0, [(0.0, 7.0), (1.0, 8.0)]), (1, 20, 6, 1.0, 2.0, [(1.0, 8.0), (2.0, 9.0)]), (2, 1, 1, 0.0, 0.5, [])]
    df = spark.createDataFrame(rows, "image long, height long, width long, t_start double, t_end double, vectors array<struct<t: double, x: double>>")
    got = {r.image: r for r in series.merged_slices(df, "image").collect()}
    assert (got[1].height, got[1].width, got[1].t_start, got[1].t_end, [tuple(v) for v in got[1].vectors]) == (30, 6, 0.0, 2.0, [(0.0, 7.0), (1.0, 8.0), (2.0, 9.0)])
    assert got[2].n_vectors == 0
