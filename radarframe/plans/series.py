"""Queries on catalogues, orbits, time series and networks derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radarframe.functions import phase
from radarframe.operators import joins, network, psi, series
from radarframe.plans.catalogue import query, table

DAILY = """daily AS (SELECT user_id AS ps, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, atan2(sum(sin(value)), sum(cos(value))) AS phi, avg(value) AS amp FROM events GROUP BY 1, 2)"""
PRODUCT = """product AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS platform, 'IW' AS mode, o_custkey // 4 AS datatake, epoch(o_orderdate) AS t0, epoch(o_orderdate) + 27 AS t1,
  o_orderstatus AS status, 'S1' || CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END || '_IW_SLC__1SDV_' || strftime(o_orderdate, '%Y%m%d') || 'T' || strftime(o_orderdate, '%H%M%S') || '_' || lpad(CAST(o_custkey // 4 AS VARCHAR), 6, '0') AS pid FROM orders)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psi.daily_phase(table(spark, sf_dir, "events").select("user_id", "ts", "value"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    take = F.floor(F.col("o_custkey") / 4)
    side = F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("S1"), side).alias("platform"), F.lit("IW").alias("mode"), take.alias("datatake"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("us"), F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("S1"), side, F.lit("_IW_SLC__1SDV_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.lpad(take.cast("string"), 6, "0")).alias("pid"),
    ).withColumn("t0", F.col("us") / 1e6).withColumn("t1", F.col("us") / 1e6 + 27).drop("us")


@query(f"WITH {PRODUCT} SELECT id, pid FROM product WHERE t0 > epoch(TIMESTAMP '1995-01-01') AND t1 < epoch(TIMESTAMP '1996-01-01') AND platform IN ('S1A') AND status <> 'P'")
def catalog_search(spark, sf_dir):
    lo, hi = (F.unix_timestamp(F.lit(d).cast("timestamp")).cast("double") for d in ("1995-01-01", "1996-01-01"))
    return products(spark, sf_dir).where((F.col("t0") > lo) & (F.col("t1") < hi) & F.col("platform").isin("S1A") & (F.col("status") != "P")).select("id", "pid")


@query(f"WITH {PRODUCT} SELECT platform, datatake, count(*) AS n, min(pid) AS first_pid, substr(min(pid), 15, 8) AS day, string_agg(pid, ',' ORDER BY pid) AS pids FROM product GROUP BY 1, 2")
def catalog_by_datatake(spark, sf_dir):
    return series.by_datatake(products(spark, sf_dir))


@query(f"WITH {PRODUCT} SELECT id, split_part(pid, '_', 1) AS mission, split_part(pid, '_', 3) AS product_type, substr(split_part(pid, '_', 6), 1, 8) AS day, CAST(split_part(pid, '_', 7) AS BIGINT) AS datatake FROM product")
def pid_parse(spark, sf_dir):
    return products(spark, sf_dir).select("id", *(v.alias(k) for k, v in series.pid_parts("pid").items()))


@query(f"WITH {PRODUCT} SELECT platform, datatake, round(min(t0) - 90, 3) AS q_start, round(max(t1) + 90, 3) AS q_end FROM product GROUP BY 1, 2")
def orbit_segments(spark, sf_dir):
    return series.orbit_queries(products(spark, sf_dir), 90).select("platform", "datatake", F.round("q_start", 3).alias("q_start"), F.round("q_end", 3).alias("q_end"))


_FILES = """f AS (SELECT l_orderkey * 10 + l_linenumber AS fid, epoch(l_shipdate) / 86400 - 1 - l_linenumber % 2 AS f_start, epoch(l_shipdate) / 86400 + 1 + l_linenumber % 3 AS f_end,
  CASE WHEN l_linenumber % 2 = 0 THEN 'POEORB' ELSE 'RESORB' END AS quality FROM lineitem),
  s AS (SELECT o_orderkey AS seg, epoch(o_orderdate) / 86400 AS s_start, epoch(o_orderdate) / 86400 + 0.001 AS s_end FROM orders)"""


@query(
    f"""WITH {_FILES} SELECT seg, fid, quality FROM (SELECT seg, fid, quality, row_number() OVER (PARTITION BY seg ORDER BY CASE quality WHEN 'POEORB' THEN 0 ELSE 1 END, fid DESC) AS k
    FROM s JOIN f ON f_start < s_start AND f_end > s_end) WHERE k = 1"""
)
def orbit_file_select(spark, sf_dir):
    """The best orbit file that strictly contains each segment: quality first, then the last name."""
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 / 86400
    n = F.col("l_linenumber")
    f = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("fid"), (day("l_shipdate") - 1 - n % 2).alias("f_start"), (day("l_shipdate") + 1 + n % 3).alias("f_end"), F.when(n % 2 == 0, "POEORB").otherwise("RESORB").alias("quality")
    )
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seg"), day("o_orderdate").alias("s_start"), (day("o_orderdate") + 0.001).alias("s_end"))
    rank = F.struct(F.when(F.col("quality") == "POEORB", 0).otherwise(1).alias("q"), (-F.col("fid")).alias("back"), "fid", "quality")
    return joins.best_containing(s, f, rank, longest=0.002, bin_width=0.125).select("seg", "best.fid", "best.quality")


@query(f"WITH {PRODUCT} SELECT platform, id // 4 AS block FROM product GROUP BY 1, 2 HAVING count(*) = count(DISTINCT substr(pid, 18, 15)) AND NOT bool_or(status = 'P')")
def weird_product_filter(spark, sf_dir):
    rows = products(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 4))
    return series.consistent(rows, ["platform", "block"], F.substring("pid", 18, 15), F.col("status") == "P")


@query("SELECT CAST(ts AS DATE) AS day FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_dates(spark, sf_dir):
    return series.complete(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type"), "day", "event_type")


@query(
    """WITH w AS (SELECT DISTINCT event_type FROM events WHERE event_id < 50), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
    SELECT day, string_agg(w.event_type, ',' ORDER BY w.event_type) AS missing FROM d, w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE CAST(e.ts AS DATE) = d.day AND e.event_type = w.event_type AND e.user_id % 3 = 0) GROUP BY day
    HAVING EXISTS (SELECT 1 FROM events e WHERE CAST(e.ts AS DATE) = d.day AND e.user_id % 3 = 0)"""
)
def dropped_dates(spark, sf_dir):
    """The dates that lack parts of the primary image, and which they lack."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "event_id", "user_id")
    found = series.dropped(e.where("user_id % 3 = 0"), "day", "event_type", e.where("event_id < 50"))
    return found.select("day", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {DAILY} SELECT ps, day, round(phi, 6) AS phi FROM daily")
def circular_mean(spark, sf_dir):
    return daily(spark, sf_dir).select("ps", "day", F.round("phi", 6).alias("phi"))


@query("SELECT user_id AS ps, count(*) AS n, round(stddev_pop(value) / avg(value), 6) AS da FROM events GROUP BY 1 HAVING stddev_pop(value) / avg(value) < 0.75")
def amplitude_dispersion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ps"), F.col("value").alias("amp"))
    return psi.dispersion(e).where("da < 0.75").select("ps", "n", F.round("da", 6).alias("da"))


_AXIS = [round(-0.45 + 0.05 * k, 2) for k in range(19)]


@query(
    f"""WITH {DAILY}, g AS (SELECT i + 19 * j AS idx, round(-0.45 + 0.05 * i, 2) AS v, round(-0.45 + 0.05 * j, 2) AS q FROM (SELECT unnest(range(19)) AS i), (SELECT unnest(range(19)) AS j)),
    o AS (SELECT ps, phi, CAST(day AS DOUBLE) AS day, CAST((day * 7) % 5 AS DOUBLE) AS b FROM daily),
    c AS (SELECT ps, idx, v, q, count(*) AS n, round(sqrt(power(sum(cos(phi - (v * day + q * b))), 2) + power(sum(sin(phi - (v * day + q * b))), 2)) / count(*), 6) AS gamma FROM o, g GROUP BY 1, 2, 3, 4)
    SELECT ps, n, gamma, CAST(idx AS INTEGER) AS idx, v, q FROM (SELECT *, row_number() OVER (PARTITION BY ps ORDER BY gamma DESC, idx) AS k FROM c) WHERE k = 1"""
)
def periodogram_grid(spark, sf_dir):
    o = daily(spark, sf_dir).select("ps", "phi", F.col("day").cast("double").alias("day"), (F.col("day") * 7 % 5).cast("double").alias("b"))
    return psi.periodogram(o, {"v": "day", "q": "b"}, psi.grid(spark, {"v": _AXIS, "q": _AXIS}))


@query(
    f"""WITH {DAILY}, g AS (SELECT i + 19 * j AS idx, round(-0.45 + 0.05 * i, 2) AS v, round(-0.45 + 0.05 * j, 2) AS q FROM (SELECT unnest(range(19)) AS i), (SELECT unnest(range(19)) AS j)),
    o AS (SELECT ps, phi, day % 4 * 0.5 AS w, CAST(day AS DOUBLE) AS day, CAST((day * 7) % 5 AS DOUBLE) AS b FROM daily WHERE day % 4 > 0),
    c AS (SELECT ps, idx, v, q, count(*) AS n, round(sqrt(power(sum(w * cos(phi - (v * day + q * b))), 2) + power(sum(w * sin(phi - (v * day + q * b))), 2)) / sum(w), 6) AS gamma FROM o, g GROUP BY 1, 2, 3, 4)
    SELECT ps, n, gamma, CAST(idx AS INTEGER) AS idx, v, q FROM (SELECT *, row_number() OVER (PARTITION BY ps ORDER BY gamma DESC, idx) AS k FROM c) WHERE k = 1"""
)
def periodogram_weighted(spark, sf_dir):
    """The grid search with a weight for each date, some of which weigh nothing."""
    day = F.col("day")
    o = daily(spark, sf_dir).select("ps", "phi", (day % 4 * 0.5).alias("w"), day.cast("double").alias("day"), (day * 7 % 5).cast("double").alias("b"))
    return psi.periodogram(o, {"v": "day", "q": "b"}, psi.grid(spark, {"v": _AXIS, "q": _AXIS}), weight="w")


@query(
    f"""WITH {DAILY}, m AS (SELECT ps, atan2(sum(sin(phi)), sum(cos(phi))) AS ref FROM daily GROUP BY ps)
    SELECT ps, day, round({'((phi - ref + pi()) - (2 * pi()) * floor((phi - ref + pi()) / (2 * pi())) - pi())'}, 5) AS residual FROM daily JOIN m USING (ps)"""
)
def phase_subtract(spark, sf_dir):
    d = daily(spark, sf_dir)
    m = d.groupBy("ps").agg(F.atan2(F.sum(F.sin("phi")), F.sum(F.cos("phi"))).alias("ref"))
    return d.join(m, "ps").select("ps", "day", F.round(phase.wrap(F.col("phi") - F.col("ref")), 5).alias("residual"))


_IMAGES = "image AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS t, round(avg(value), 9) * 100 AS b FROM events GROUP BY 1)"


def images(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    e = table(spark, sf_dir, "events").groupBy(day.alias("id")).agg(F.round(F.avg("value"), 9).alias("b"))
    return e.select("id", F.col("id").cast("double").alias("t"), (F.col("b") * 100).alias("b"))


_PAIRS = f"{_IMAGES}, p AS (SELECT a.id AS id1, b.id AS id2, abs(b.t - a.t) AS dt, abs(b.b - a.b) AS db FROM image a JOIN image b ON a.id < b.id)"


@query(f"WITH {_PAIRS} SELECT id1, id2, dt, round(db, 5) AS db FROM p")
def pairs_all(spark, sf_dir):
    return network.all_pairs(images(spark, sf_dir)).select("id1", "id2", "dt", F.round("db", 5).alias("db"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(sum(dt), 4) AS sum_dt, round(sum(db), 3) AS sum_db FROM p WHERE dt <= 6")
def pair_costs(spark, sf_dir):
    return network.costs(network.all_pairs(images(spark, sf_dir)).where("dt <= 6")).select("n", F.round("sum_dt", 4).alias("sum_dt"), F.round("sum_db", 3).alias("sum_db"))


@query(f"WITH {_PAIRS} SELECT id1, id2 FROM p WHERE NOT (dt <= 6 AND id1 % 3 = 0)")
def pair_difference(spark, sf_dir):
    p = network.all_pairs(images(spark, sf_dir))
    return series.without(p, p.where("dt <= 6 and id1 % 3 = 0"))


@query(
    """WITH RECURSIVE v AS (SELECT s_suppkey AS id FROM supplier), e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey + 7 IN (SELECT id FROM v)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id AS c FROM v UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id"""
)
def connected_components(spark, sf_dir):
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    e = v.where("id % 5 <> 0").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")).join(v.select(F.col("id").alias("b")), "b", "left_semi")
    return network.components(v, e, _written)


def shared_folder(spark, name: str) -> str:
    """A new path in the folder that driver and executors share; under a local master without one, in a temporary folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base}/radarframe/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "labels")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query(
    """WITH r AS (SELECT p_size AS burst, p_partkey AS idx, CAST(p_retailprice AS DOUBLE) AS rt, p_partkey * 1.5 AS c0 FROM part), q AS (SELECT s_suppkey AS id, s_suppkey % 50 + 1 AS burst, 900 + s_suppkey % 400 + 0.25 AS t FROM supplier)
    SELECT id, idx, round(rt, 4) AS rt FROM (SELECT q.id, r.idx, r.rt, row_number() OVER (PARTITION BY q.id ORDER BY abs(r.rt - q.t), r.idx) AS k FROM q JOIN r USING (burst)) WHERE k = 1"""
)
def nearest_doppler_record(spark, sf_dir):
    return _near(spark, sf_dir, 1).select("id", F.col("near")[0].r.idx.alias("idx"), F.round(F.col("near")[0].r.rt, 4).alias("rt"))


@query(
    """WITH r AS (SELECT p_size AS burst, p_partkey AS idx, CAST(p_retailprice AS DOUBLE) AS rt, p_partkey * 1.5 AS c0 FROM part), q AS (SELECT s_suppkey AS id, s_suppkey % 50 + 1 AS burst, 900 + s_suppkey % 400 + 0.25 AS t FROM supplier),
    k AS (SELECT q.id, q.t, r.rt, r.c0, row_number() OVER (PARTITION BY q.id ORDER BY abs(r.rt - q.t), r.idx) AS k FROM q JOIN r USING (burst))
    SELECT a.id, round(CASE WHEN a.rt = b.rt THEN a.c0 ELSE a.c0 + (a.t - a.rt) / (b.rt - a.rt) * (b.c0 - a.c0) END, 4) AS c0 FROM k a JOIN k b ON a.id = b.id AND a.k = 1 AND b.k = 2"""
)
def srgr_two_nearest(spark, sf_dir):
    a, b = F.col("near")[0].r, F.get("near", F.lit(1)).r
    lerp = F.when(a.rt == b.rt, a.c0).otherwise(a.c0 + (F.col("t") - a.rt) / (b.rt - a.rt) * (b.c0 - a.c0))
    return _near(spark, sf_dir, 2).where("size(near) = 2").select("id", F.round(lerp, 4).alias("c0"))


def _near(spark, sf_dir, n):
    r = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("burst"), F.col("p_partkey").alias("idx"), F.col("p_retailprice").cast("double").alias("rt"), (F.col("p_partkey") * 1.5).alias("c0"))
    k = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 50 + 1).alias("burst"), (900 + k % 400 + 0.25).alias("t"))
    return joins.nearest_records(q, r, "burst", n)


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def last_n_products(spark, sf_dir):
    return psi.latest_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT l_partkey AS row, l_suppkey AS slice, l_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_writer_rows(spark, sf_dir):
    first = F.min(F.struct("l_suppkey", "l_orderkey", "l_linenumber")).alias("f")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row")).agg(first).select("row", F.col("f.l_suppkey").alias("slice"), F.col("f.l_orderkey").alias("line"))


@query("SELECT l_partkey AS row, l_orderkey AS tile, round(l_quantity, 4) AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1")
def stitch_last_wins(spark, sf_dir):
    last = F.max(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("f")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row")).agg(last).select("row", F.col("f.l_orderkey").alias("tile"), F.round("f.l_quantity", 4).alias("v"))


@query(
    f"""WITH {DAILY}, x AS (SELECT ps, day, phi - lead(phi) OVER (PARTITION BY ps ORDER BY day) AS d FROM daily), b AS (SELECT ps, atan2(avg(sin(d)), avg(cos(d))) AS phi FROM x WHERE d IS NOT NULL GROUP BY ps)
    SELECT count(*) AS n, round(avg(phi / (2 * pi() * (4500 + ps % 7))), 12) AS shift FROM b"""
)
def esd_shift(spark, sf_dir):
    x = daily(spark, sf_dir).withColumn("d", F.col("phi") - F.lead("phi").over(Window.partitionBy("ps").orderBy("day"))).where("d is not null")
    # an overlap's bursts are seen under Doppler frequencies that differ by some kilohertz
    return series.esd_shift(x.withColumn("doppler", (4500 + F.col("ps") % 7).cast("double")), "ps", "d", "doppler").select("n", F.round("shift", 12).alias("shift"))


@query(f"WITH {PRODUCT} SELECT id, CAST(floor((t0 % 5924) / 2.758273) + 1 AS BIGINT) AS slice, lpad(CAST(CAST(floor((t0 % 5924) / 2.758273) + 1 AS BIGINT) AS VARCHAR), 6, '0') || '_iw1' AS bsid FROM product")
def slice_ids(spark, sf_dir):
    n = (F.floor((F.col("t0") % 5924) / 2.758273) + 1).cast("long")
    return products(spark, sf_dir).select("id", n.alias("slice"), F.concat(F.lpad(n.cast("string"), 6, "0"), F.lit("_iw1")).alias("bsid"))


@query("SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def osid_intersection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey"))
    return series.in_both(table(spark, sf_dir, "supplier"), c, "s_nationkey")


@query(
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS height, round(max(o_totalprice), 2) AS width, min(o_orderdate) AS t_start, max(o_orderdate) AS t_end, count(DISTINCT o_orderdate) AS n_vectors FROM orders GROUP BY 1"""
)
def grd_merge(spark, sf_dir):
    vector = F.array(F.struct(F.col("o_orderdate").alias("t")))
    s = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("height"), F.col("o_totalprice").alias("width"), F.col("o_orderdate").alias("t_start"), F.col("o_orderdate").alias("t_end"), vector.alias("vectors"))
    return series.merged_slices(s, "o_custkey").select("o_custkey", "n", F.round("height", 2).alias("height"), F.round("width", 2).alias("width"), "t_start", "t_end", "n_vectors")


@query(
    """WITH b AS (SELECT l_suppkey AS swath, l_orderkey * 10 + l_linenumber AS burst, epoch(l_shipdate) / 86400 AS t0, epoch(l_shipdate) / 86400 + l_quantity AS t1 FROM lineitem),
    n AS (SELECT *, lead(burst) OVER w AS next_burst, lead(t0) OVER w AS next_t0 FROM b WINDOW w AS (PARTITION BY swath ORDER BY t0, burst))
    SELECT swath, burst, next_burst, CAST(round((t1 - next_t0) * 4) AS INTEGER) AS overlap FROM n WHERE next_t0 < t1"""
)
def overlap_bursts(spark, sf_dir):
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6 / 86400
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("swath"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("burst"), t.alias("t0"), (t + F.col("l_quantity")).alias("t1"))
    return series.overlaps(b, 4)
