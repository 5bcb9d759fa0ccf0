"""Folded series against numpy's, derivatives included."""

import numpy as np
import pandas as pd
import pytest
from numpy.polynomial import chebyshev, legendre, polynomial
from pyspark.sql import functions as F

from radarframe.functions import polynomials

RNG = np.random.default_rng(6)
MODULES = {"standard": (polynomial.polyval, polynomial.polyder, polynomial.polyval2d), "chebyshev": (chebyshev.chebval, chebyshev.chebder, chebyshev.chebval2d), "legendre": (legendre.legval, legendre.legder, legendre.legval2d)}


@pytest.mark.parametrize("kind", polynomials.KINDS)
def test_series_and_slopes(spark, kind):
    value, slope, _ = MODULES[kind]
    rows = [(k, RNG.normal(size=n).tolist(), float(x)) for k, (n, x) in enumerate((n, x) for n in (1, 2, 3, 9, 16) for x in (-1.0, -0.3, 0.0, 0.77, 1.0))] + [(99, [], 0.5)]
    df = spark.createDataFrame(rows, "id long, c array<double>, x double")
    got = {r.id: r for r in df.select("id", polynomials.series(kind, F.col("c"), F.col("x")).alias("s")).select("id", "s.*").collect()}
    for k, c, x in rows[:-1]:
        assert got[k].value == pytest.approx(value(x, c), abs=1e-10) and got[k].slope == pytest.approx(value(x, slope(c)) if len(c) > 1 else 0, abs=1e-9)
    assert (got[99].value, got[99].slope) == (0.0, 0.0)


@pytest.mark.parametrize("kind", polynomials.KINDS)
def test_surfaces_and_their_slopes(spark, kind):
    _, slope, value = MODULES[kind]
    c = RNG.normal(size=(5, 7))
    x, y = RNG.uniform(-1, 1, (2, 40))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).withColumn("c", F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in c)))
    got = df.select("x", "y", polynomials.surface(kind, F.col("c"), F.col("x"), F.col("y")).alias("s")).select("x", "y", "s.*").toPandas()
    assert np.allclose(got["value"], value(got["x"], got["y"], c), atol=1e-9)
    assert np.allclose(got["dx"], value(got["x"], got["y"], slope(c, axis=0)), atol=1e-9) and np.allclose(got["dy"], value(got["x"], got["y"], slope(c, axis=1)), atol=1e-9)


def test_kinds_may_differ_by_axis_and_unknown_ones_fail(spark):
    c = [[1.0, 2.0], [0.5, -1.0]]
    df = spark.createDataFrame([(c, 0.3, -0.4)], "c array<array<double>>, x double, y double")
    got = df.select(polynomials.surface("chebyshev", F.col("c"), F.col("x"), F.col("y"), "standard").alias("s")).first().s
    assert got.value == pytest.approx(1 - 0.8 + 0.3 * (0.5 + 0.4)) and got.dx == pytest.approx(0.9) and got.dy == pytest.approx(2 - 0.3)
    with pytest.raises(ValueError):
        polynomials.series("hermite", F.lit(1), F.lit(1))


def test_scaled(spark):
    assert spark.range(1).select(*(polynomials.scaled(F.lit(float(v)), 2.0, 6.0).alias(f"c{v}") for v in (2, 4, 6))).first() == (-1.0, 0.0, 1.0)
