"""Interferogram networks: image pairs, their costs, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_pairs(images: DataFrame) -> DataFrame:
    """Each unordered pair of images (id, t, b) once, with the differences. Images of a stack are some hundred acquisitions."""
    a, b = (images.select(F.col("id").alias(f"id{k}"), F.col("t").alias(f"t{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
    return a.join(b, F.col("id1") < F.col("id2")).withColumn("dt", F.abs(F.col("t2") - F.col("t1"))).withColumn("db", F.abs(F.col("b2") - F.col("b1")))


def costs(pairs: DataFrame) -> DataFrame:
    """One row: number of pairs, summed differences, and validity."""
    return pairs.agg(F.count("*").alias("n"), F.sum("dt").alias("sum_dt"), F.sum("db").alias("sum_db"))


def degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def components(vertices: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b). Labels spread and jump to their label's label until none changes.

    ``checkpoint`` cuts a table's lineage, such as DataFrame.checkpoint or a table written to shared storage.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    labels = checkpoint(vertices.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("low"))
        spread = labels.join(seen, labels["id"] == seen["a"], "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        jump = spread.select(F.col("id").alias("j"), F.col("component").alias("further"))
        moved = spread.join(jump, spread["component"] == jump["j"]).select("id", F.least("component", "further").alias("component"), "was")
        moved = checkpoint(moved)
        if moved.where("component <> was").isEmpty():
            return moved.select("id", "component")
        labels = moved.select("id", "component")


def selected(pairs: DataFrame, time_weight: float = 1.0, base_weight: float = 1.0, max_dt: float | None = None, max_db: float | None = None, max_degree: int | None = None, max_pairs: int | None = None, connect: bool = True, by: str = "stack") -> DataFrame:
    """by, id1, id2, cost, bridge: of each stack's pairs (by, id1, id2, dt, db) those a greedy choice keeps.

    The cheapest pair that breaks no limit is added until none is left; costs add up and limits only
    tighten, so one pass in order of cost does that. With ``connect``, the cheapest pairs between components
    follow as bridges, whatever the limits. Equal costs go by id1, then id2. Filters by pair run in Spark; a
    stack's pairs are one group, bounded by the square of its acquisitions.
    """
    cost = time_weight * F.col("dt") + base_weight * F.col("db")
    fits = F.lit(True)
    for c, top in (("dt", max_dt), ("db", max_db)):
        fits = fits if top is None else fits & (F.col(c) <= top)
    rows = pairs.select(by, "id1", "id2", cost.cast("double").alias("cost"), fits.alias("fits"))
    kinds = dict(rows.dtypes)

    def choose(pdf):
        pdf = pdf.sort_values(["cost", "id1", "id2"], kind="stable")
        degree: dict = {}
        parent: dict = {}
        keep, bridge = [], []

        def find(k):
            while parent.setdefault(k, k) != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        rows = list(pdf[["id1", "id2", "fits"]].itertuples(index=False))
        for n, (a, b, ok) in enumerate(rows):
            if ok and (max_pairs is None or len(keep) < max_pairs) and (max_degree is None or max(degree.get(a, 0), degree.get(b, 0)) < max_degree):
                keep.append(n)
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
                parent[find(a)] = find(b)
        if connect:
            for n, (a, b, _) in enumerate(rows):
                if find(a) != find(b):
                    bridge.append(n)
                    parent[find(a)] = find(b)
        out = pdf.iloc[[*keep, *bridge]][[by, "id1", "id2", "cost"]].copy()
        out["bridge"] = [False] * len(keep) + [True] * len(bridge)
        return out

    return rows.groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, id1 {kinds['id1']}, id2 {kinds['id2']}, cost double, bridge boolean")
