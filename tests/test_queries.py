"""Every radar query that has SQL gives the SQL's rows."""

import os

import duckdb
import pandas as pd
import pytest

from radarframe.plans import catalogue, dense, files, library, pixels, points, products, series, stack  # noqa: F401  the latter register queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)

    def shown(v):
        return "-" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(map(shown, r)) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    ours = catalogue.queries()[name](spark, SF).toPandas()
    theirs = db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differing, differing[:3]


def test_entry_point_offers_the_queries():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
