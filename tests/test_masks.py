"""Run-length masks: ranks, places and conversions against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radarframe.operators import masks

RNG = np.random.default_rng(12)
IMAGES = {1: RNG.random((30, 40)) < 0.3, 2: RNG.random((30, 40)) < 0.95, 3: np.zeros((30, 40), bool)}
IMAGES[2][7] = False
IMAGES[2][8] = True


@pytest.fixture(scope="module")
def pixels(spark):
    r, c = np.mgrid[0:30, 0:40].reshape(2, -1)
    rows = [pd.DataFrame({"id": k, "row": r, "col": c, "m": m.ravel(), "v": RNG.normal(size=1200)}) for k, m in IMAGES.items()]
    return spark.createDataFrame(pd.concat(rows)).repartition(4).cache()


@pytest.fixture(scope="module")
def mask(pixels):
    return masks.encoded(pixels, F.col("m"), ["id"]).cache()


def test_runs_are_few_and_count_pixels(mask):
    got = mask.toPandas()
    for k, m in IMAGES.items():
        one = got[got["id"] == k].sort_values("row")
        assert one["n"].sum() == m.sum() and one["row"].tolist() == np.nonzero(m.any(axis=1))[0].tolist()
        assert sum(map(len, one["runs"])) == (np.diff(np.pad(m, ((0, 0), (1, 1))).astype(int), axis=1) == 1).sum()
    assert len(got[(got["id"] == 2) & (got["row"] == 8)]["runs"].iloc[0]) == 1


def test_ranks_and_places(pixels, mask):
    ranks = masks.ranked(pixels, mask, ["id"]).toPandas()
    for k, m in IMAGES.items():
        one = ranks[ranks["id"] == k].sort_values(["row", "col"])
        want = np.where(m.ravel(), np.cumsum(m.ravel()) - 1, -1)
        assert (one["rank"].fillna(-1).to_numpy() == want).all()
    known = pixels.sparkSession.createDataFrame(ranks.dropna()[["id", "rank", "v"]]).withColumn("rank", F.col("rank").cast("long"))
    back = masks.placed(known, mask, ["id"]).toPandas().merge(ranks.dropna(), on=["id", "rank"])
    assert len(back) == sum(m.sum() for m in IMAGES.values()) and (back["row_x"] == back["row_y"]).all() and (back["col_x"] == back["col_y"]).all()
    assert masks.placed(pixels.sparkSession.createDataFrame([(1, 10**9), (3, 0)], "id long, rank long"), mask, ["id"]).count() == 0


def test_many_buckets(pixels, mask, monkeypatch):
    monkeypatch.setattr(masks, "BUCKET", 7)
    series = masks.sparse(pixels, mask, ["v"], ["id"])
    assert masks.placed(series, mask, ["id"]).count() == series.count() == sum(m.sum() for m in IMAGES.values())


def test_sparse_to_dense_and_back(pixels, mask):
    series = masks.sparse(pixels, mask, ["v"], ["id"])
    whole = masks.dense(series, mask, "v", 40, 30, ["id"])
    got = whole.toPandas()
    assert len(got) == 2 * 1200  # the empty mask has no image
    want = pixels.toPandas().merge(got, on=["id", "row", "col"])
    assert (want["v_y"].isna() == ~want["m"]).all() and (want["v_x"] == want["v_y"])[want["m"]].all()
    again = masks.sparse(whole.where("v is not null"), mask, ["v"], ["id"])
    assert again.exceptAll(series).count() == 0 and series.exceptAll(again).count() == 0


def test_lacking_values_are_null_and_repeats_count_once(spark):
    twice = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (2, 0)], "row long, col long")
    mask = masks.encoded(twice, F.lit(True))
    assert {(r.row, r.n, r.before) for r in mask.collect()} == {(0, 2, 0), (2, 1, 2)}
    got = masks.dense(spark.createDataFrame([(1, 5.0)], "rank long, v double"), mask, "v", 3).orderBy("row", "col").collect()
    assert [r.v for r in got] == [None, None, 5.0, None, None, None]
