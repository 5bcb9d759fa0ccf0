"""Registry of the queries over the radar operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def positive_zero(sql: str) -> str:
    """``sql`` with 0.0 added to each rounded value: Spark rounds small negative numbers to 0.0, DuckDB to -0.0."""
    at = 0
    while (m := re.compile(r"\bround\(").search(sql, at)) is not None:
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[: m.start()]}({sql[m.start() : end]} + 0.0){sql[end:]}"
        at = m.end() + 1
    return sql


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = positive_zero(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@query(
    """
    WITH daily AS (
      SELECT user_id AS ps, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
             atan2(sum(sin(value)), sum(cos(value))) AS phi
      FROM events GROUP BY 1, 2)
    SELECT ps, count(*) AS n_days,
           round(sqrt(power(sum(cos(phi)), 2) + power(sum(sin(phi)), 2)) / count(*), 6) AS gamma
    FROM daily GROUP BY ps HAVING count(*) >= 5
    """
)
def temporal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    daily = events.groupBy(F.col("user_id").alias("ps"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(
        F.atan2(F.sum(F.sin("value")), F.sum(F.cos("value"))).alias("phi")
    )
    length = F.sqrt(F.pow(F.sum(F.cos("phi")), F.lit(2.0)) + F.pow(F.sum(F.sin("phi")), F.lit(2.0)))
    return daily.groupBy("ps").agg(F.count("*").alias("n_days"), F.round(length / F.count("*"), 6).alias("gamma")).where("n_days >= 5")
