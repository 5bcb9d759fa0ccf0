"""Helpers the text operators share: staged tables, row keys, range lookup, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of over a ``MOST_HOT``-th of the rows, but ``LEAST_HOT`` at least, are hot: fewer than ``MOST_HOT`` of them.
MOST_HOT, LEAST_HOT = 4096, 256


#: Python workers get Arrow batches of so many bytes, so that batches of very long texts fit beside each other.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to ``BATCH_BYTES`` if it is higher. It bounds bytes and not rows, so batches of short rows stay as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one in local mode, as in tests, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="radarframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/radarframe/{name}-{uuid.uuid4().hex}"
    files, at = _folder(spark, path)
    files.mkdirs(at.getParent())
    files.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there,
    and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.staged_at = path
    return held


def drop_staged(df: DataFrame) -> None:
    """Removes a table that :func:`staged` wrote and nothing will read again."""
    files, at = _folder(df.sparkSession, df.staged_at)
    files.delete(at, True)


def bounded_sample(rows: DataFrame, draw: Column, size: Column, most_rows: int, most_bytes: int) -> list:
    """The first rows in the order of ``draw``, whole, as many as ``most_rows`` and ``most_bytes`` allow; rows of over an eighth of those bytes are passed over.

    Places and sizes are drawn first, so that no more than that is ever held, however often rows are repeated.
    """
    drawn = rows.withColumns({"__draw": draw, "__size": size}).where(F.col("__size") <= most_bytes // 8)
    first, room = 0, most_bytes
    few = drawn.select("__draw", "__size").orderBy("__draw").limit(most_rows).collect()
    for r in few:
        room -= r["__size"]
        if room < 0:
            break
        first += 1
    if not first:
        return []
    return drawn.where(F.col("__draw") <= few[first - 1]["__draw"]).orderBy("__draw").limit(first).drop("__draw", "__size").collect()


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``keyed``, of few rows a key, on columns that both have; no task gets all rows of a hot key.

    Hot keys, of bounded number, are counted first; their rows are dealt to as many salts as they have shares of ``rows``, and
    those of ``keyed`` go to each. ``rows`` must be a staged table or one computed from it row by row, so that a task that is run again deals alike.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    limit = max(LEAST_HOT, (rows.count() or 0) // MOST_HOT)
    hot = F.broadcast(counts.where(F.col("__n") > limit).select(*on, F.expr(f"cast(__n div {limit} as int) + 1").alias("__salts")))
    dealt = rows.join(hot, on, "left").withColumn("__salt", F.expr("cast(pmod(xxhash64(monotonically_increasing_id()), coalesce(__salts, 1)) as int)")).drop("__salts")
    each = keyed.join(hot, on, "left").withColumn("__salt", F.explode(F.expr("sequence(0, coalesce(__salts, 1) - 1)"))).drop("__salts")
    return dealt.join(each, [*on, "__salt"], how).drop("__salt")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does the same on ASCII and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def words_of(text: Column) -> Column:
    """Maximal runs outside ASCII white space."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def shingle_hashes(text: Column, size: int, out: str, docs: DataFrame) -> DataFrame:
    """``docs`` with ``out``: array of XXH64 (seed 42) of each word shingle of ``text``, repeats included."""
    rest = ", ".join(f"get(__w, i + {k})" for k in range(1, size))
    return (
        docs.withColumn("__t", lower_az(text))
        .withColumn("__w", words_of(F.col("__t")))
        .withColumn(
            out,
            F.expr(
                f"case when size(__w) >= {size} then transform(slice(__w, 1, size(__w) - {size - 1}), (x, i) -> xxhash64(concat_ws(' ', x, {rest})))"
                " when size(__w) > 0 then array(xxhash64(array_join(__w, ' '))) else cast(array() as array<bigint>) end"
            ),
        )
        .drop("__t", "__w")
    )


def range_index(value: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= value: a binary search folded over a literal array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length() + 1
    array = "array(" + ",".join(f"{b}L" if b > -(2**63) else "-9223372036854775807L - 1L" for b in bounds) + ")"
    middle = "cast((s.lo + s.hi) div 2 as int)"
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}),"
        f" (s, k) -> case when s.lo >= s.hi then s"
        f" when get({array}, {middle}) <= {value} then named_struct('lo', {middle} + 1, 'hi', s.hi)"
        f" else named_struct('lo', s.lo, 'hi', {middle}) end, s -> s.lo)"
    )


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each task replaced by stars with the same connected components."""

    def contract(batches):
        import numpy as np
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 200_000:
                yield star(parent, find, np, pa)
                parent.clear()
        if parent:
            yield star(parent, find, np, pa)

    def star(parent, find, np, pa):
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        a = np.array([p[0] for p in pairs], dtype="int64")
        b = np.array([p[1] for p in pairs], dtype="int64")
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternating large and small stars: each round links neighbours to the smallest one they see,
    and rounds grow with the logarithm of a component's diameter. Only two scalars a round reach the driver.
    """
    e = staged(
        local_forest(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # of the neighbours above a node, each goes to the least one it sees
        large = spread_join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        done = staged(small.where("u <> v").distinct(), "star")
        for old in (e, large):
            drop_staged(old)
        e = done
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
