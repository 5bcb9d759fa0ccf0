"""Hard negatives by a vector-approximation file.

Vectors are quantised: each dimension is cut at quantiles of the whole table into ``2 ** BITS`` cells, and a row's
approximation is its cells, two to a byte. For an anchor and a pair of dimensions a table holds the least and the largest
share of the score that a cell of that pair can give; a row's bounds are sums of looked-up entries. Only rows whose bounds let them
enter an anchor's best positives, or a window of negative scores, are scored exactly.

Anchors and rows meet in blocks: rows are dealt to blocks by hash, anchors to groups, and each pair of a block and a group is one
task's work, which gives at most as many rows a block and anchor as the result can take from it. So nothing is
broadcast or gathered but the cells' bounds, and the work is anchors times rows, as table lookups.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; rows that agree in
id, label and vector are one row; other rows of the same id are rows of their own, and ties among them don't show; rows without an id
are no anchors and come last among ties; components that a shorter vector lacks count as zero, so an empty vector scores 0
everywhere; a block is as wide as its longest vector; a positive score below zero has no negatives, and one of zero only those of zero; labels of 0 to 9 and others alike turn
to (label + 1) % 10 where the contract's query asks for it; scores are exact while they fit 64 bits; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 4
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows in a block and anchors in a group at most, about; blocks hold a quarter of what a core would get, LEAST_BLOCK at least.
MOST_BLOCK, LEAST_BLOCK = 65_536, 1_024
#: Anchors whose bounds a worker holds at a time.
CHUNK = 32


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q: array<bigint> = floor(scale * x), of each distinct row that takes part."""
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.expr("transform(embedding, x -> cast(x as double))").alias("x"))
    sound = sound.where("label is not null and x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    return sound.select("vec_id", "label", F.expr(f"transform(x, v -> cast(floor({scale} * v) as bigint))").alias("q")).distinct()


def cell_bounds(vectors: DataFrame, bits: int = BITS) -> list[list[int]]:
    """Of each dimension: the least component, the cuts between cells, and the largest; from all rows. As long as a vector is."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    each = vectors.select(F.posexplode("q").alias("at", "v")).groupBy("at").agg(F.min("v").alias("lo"), F.percentile_approx("v", shares, 1000).alias("cuts"), F.max("v").alias("hi"))
    return [[r["lo"], *r["cuts"], r["hi"]] for r in each.orderBy("at").collect()]


class Cells:
    """The cells of each dimension: values v with ``cuts[c - 1] < v <= cuts[c]``; those beyond the last cut are the last cell's."""

    def __init__(self, bounds: list[list[int]]):
        import numpy as np

        b = np.array(bounds, dtype=np.int64).reshape(len(bounds), len(bounds[0]) if bounds else 3)
        self.cuts = b[:, 1:-1]
        # a cell's values lie within these, both included; a missing component is 0
        self.low = np.minimum(np.concatenate([b[:, :1], np.minimum(b[:, 1:-1] + 1, b[:, -1:])], axis=1), np.iinfo(np.int64).max)
        self.high = np.concatenate([b[:, 1:-1], b[:, -1:]], axis=1)

    def of(self, q):
        """A matrix of cells, two dimensions to a byte."""
        import numpy as np

        n, dims = q.shape
        cells = np.zeros((n, dims + dims % 2), np.uint8)
        for d in range(dims):
            cells[:, d] = np.searchsorted(self.cuts[d], q[:, d], "left")
        return cells[:, 0::2] | (cells[:, 1::2] << 4)

    def tables(self, anchors):
        """Least and largest shares of the score, by anchor, pair of dimensions and byte."""
        import numpy as np

        n, dims = anchors.shape
        a = anchors.astype(np.float64)[:, :, None]
        at_low, at_high = a * self.low[:dims], a * self.high[:dims]
        least, most = np.minimum(at_low, at_high), np.maximum(at_low, at_high)
        if dims % 2:
            least, most = (np.concatenate([x, np.zeros((n, 1, x.shape[2]))], axis=1) for x in (least, most))
        width = least.shape[2]

        def paired(x):
            wide = np.zeros((n, x.shape[1], 16))
            wide[:, :, :width] = x
            return (wide[:, 1::2, :, None] + wide[:, 0::2, None, :]).reshape(n, -1, 256)

        return paired(least), paired(most)


def looked_up(tables, cells):
    """The bounds of every row for every anchor of the tables: (least, largest)."""
    import numpy as np

    # rounding of sums of whole products beyond 2 ** 53 can't turn a bound around
    out = []
    for t in tables:
        total = np.zeros((t.shape[0], cells.shape[0]))
        for p in range(t.shape[1]):
            total += np.take(t[:, p], cells[:, p], axis=1)
        out.append(total)
    slack = [np.abs(x) * 1e-12 if len(x) and np.abs(x).max(initial=0) > 2.0**52 else 0.0 for x in out]
    return out[0] - slack[0], out[1] + slack[1]


def exact(vectors, anchor):
    """Whole inner products."""
    import numpy as np

    if np.abs(vectors).max(initial=0) < 2**20 and np.abs(anchor).max(initial=0) < 2**20 and len(anchor) < 2**12:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return (vectors * anchor).sum(axis=1)


def _matrix(column):
    """An Arrow list column as a matrix, shorter rows filled with zeros."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = values
    return out


def _prepared(anchors, rows, cells: Cells):
    """Arrays of both sides, as wide as the narrower: what one lacks counts as zero."""
    import numpy as np

    a, q = _matrix(anchors.column("q")), _matrix(rows.column("q"))
    wide = min(a.shape[1], q.shape[1])
    a, q = a[:, :wide], q[:, :wide]
    ids = rows.column("vec_id").to_pandas().to_numpy(dtype=object)
    order = np.array([np.iinfo(np.int64).max if x is None or x != x else int(x) for x in ids], dtype=np.int64)
    col = lambda t, c: t.column(c).to_numpy()
    return a, q, cells.of(q), order, col(anchors, "label"), col(rows, "label"), col(anchors, "k"), col(rows, "k")


def best_positives(most: int, cells: Cells):
    """A function of a group of anchors and a block of rows: the block's best rows of each anchor's label."""

    def work(anchors, rows):
        import numpy as np
        import pyarrow as pa

        a, q, codes, ids, a_label, r_label, a_key, r_key = _prepared(anchors, rows, cells)
        out_a, out_id, out_score = [], [], []
        for label in np.unique(a_label):
            mine, theirs = np.nonzero(a_label == label)[0], np.nonzero(r_label == label)[0]
            for lo in range(0, len(mine) if len(theirs) else 0, CHUNK):
                some = mine[lo : lo + CHUNK]
                least, largest = looked_up(cells.tables(a[some]), codes[theirs])
                own = a_key[some][:, None] == r_key[theirs][None]
                least[own], largest[own] = -np.inf, -np.inf
                if len(theirs) > most:  # the most-th best score is no less than the most-th best lower bound
                    bound = np.partition(least, len(theirs) - most, axis=1)[:, len(theirs) - most]
                else:
                    bound = np.full(len(some), -np.inf)
                for k, i in enumerate(some):
                    at = theirs[(largest[k] >= bound[k]) & ~own[k]]
                    score = exact(q[at], a[i])
                    first = np.lexsort((ids[at], -score))[:most]
                    out_a.append(np.full(len(first), a_key[i]))
                    out_id.append(at[first])
                    out_score.append(score[first])
        at = np.concatenate(out_id) if out_id else np.zeros(0, np.int64)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cat(out_a), pa.int64()), "positive_id": rows.column("vec_id").take(pa.array(at, pa.int64())), "k": pa.array(r_key[at], pa.int64()), "positive_score": pa.array(cat(out_score), pa.int64())})

    return work


def window_negatives(most: int, low: int, high: int, cells: Cells):
    """A function of a group of anchors with their positives' scores and a block of rows: the block's best rows of other labels in each score's window."""

    def work(anchors, rows):
        import numpy as np
        import pyarrow as pa

        a, q, codes, ids, a_label, r_label, a_key, r_key = _prepared(anchors, rows, cells)
        scores = [np.array(x, dtype=np.int64) for x in anchors.column("scores").to_pylist()]
        out = {"a": [], "positive_score": [], "at": [], "negative_score": []}
        for lo in range(0, len(a), CHUNK):
            some = np.arange(lo, min(len(a), lo + CHUNK))
            least, largest = looked_up(cells.tables(a[some]), codes)
            for k, i in enumerate(some):
                other = r_label != a_label[i]
                wanted = np.zeros(len(r_label), bool)
                windows = [(s, -(-low * s // 100), high * s // 100) for s in np.unique(scores[i]).tolist() if s >= 0]
                for _, bottom, top in windows:
                    may = other & (largest[k] >= bottom) & (least[k] <= top)
                    sure = least[k][other & (least[k] >= bottom) & (largest[k] <= top)]
                    if len(sure) >= most:  # so many rows surely inside: what can't reach the worst of them doesn't enter
                        may &= largest[k] >= np.partition(sure, len(sure) - most)[len(sure) - most]
                    wanted |= may
                at = np.nonzero(wanted)[0]
                if not len(at):
                    continue
                score = exact(q[at], a[i])
                order = np.lexsort((ids[at], -score))
                at, score = at[order], score[order]
                for s, bottom, top in windows:
                    inside = np.nonzero((score >= bottom) & (score <= top))[0][:most]
                    out["a"].append(np.full(len(inside), a_key[i]))
                    out["positive_score"].append(np.full(len(inside), s))
                    out["at"].append(at[inside])
                    out["negative_score"].append(score[inside])
        cat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
        return pa.table({
            "a": pa.array(cat["a"], pa.int64()), "positive_score": pa.array(cat["positive_score"], pa.int64()), "negative_id": rows.column("vec_id").take(pa.array(cat["at"], pa.int64())),
            "k": pa.array(r_key[cat["at"]], pa.int64()), "negative_score": pa.array(cat["negative_score"], pa.int64()),
        })

    return work


def met(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, work, schema: str) -> DataFrame:
    """``work`` on each group of ``anchors`` and each block of ``rows``, dealt by the hash of ``k``."""
    a = anchors.withColumn("g", F.expr(f"cast(pmod(xxhash64(k), {groups}) as int)")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = rows.withColumn("b", F.expr(f"cast(pmod(xxhash64(k, 1), {blocks}) as int)")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def both(left, right):
        if not left.num_rows or not right.num_rows:  # one side has nothing here
            left, right = left.slice(0, 0), right.slice(0, 0)
        return work(left, right)

    return a.groupBy("g", "b").cogroup(r.groupBy("g", "b")).applyInArrow(both, schema)


def mined(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, bits: int = BITS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows (vec_id, label, embedding); anchors are rows whose id ``every`` divides."""
    if bits > 4:
        raise ValueError("cells of two dimensions share a byte: 4 bits at most")
    spark = rows.sparkSession
    common.small_batches(spark)
    held = common.staged(quantised(rows).withColumn("k", F.monotonically_increasing_id()), "vectors")
    cells = Cells(cell_bounds(held, bits))
    n, n_anchors = held.agg(F.count("*"), F.count(F.when(F.expr(f"vec_id % {every} = 0"), 1))).first()
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(-(-n // MOST_BLOCK), min(4 * cores, -(-n // LEAST_BLOCK)), 1)
    groups = max(1, -(-n_anchors // MOST_BLOCK))
    anchors = spark.read.schema(held.schema).parquet(held.staged_at).where(f"vec_id % {every} = 0")

    found = met(anchors, held, groups, blocks, best_positives(positives, cells), "a long, positive_id long, k long, positive_score long")
    found = common.staged(found.withColumn("r", F.expr("row_number() over (partition by a order by positive_score desc, positive_id asc nulls last, k)")).where(f"r <= {positives}"), "positives")
    scores = found.groupBy(F.col("a").alias("k")).agg(F.collect_set("positive_score").alias("scores"))  # ``positives`` an anchor at most
    windows = met(anchors.join(scores, "k"), held, groups, blocks, window_negatives(negatives, low, high, cells), "a long, positive_score long, negative_id long, k long, negative_score long")
    best = windows.withColumn("rank", F.expr("row_number() over (partition by a, positive_score order by negative_score desc, negative_id asc nulls last, k)")).where(f"rank <= {negatives}")
    named = anchors.select(F.col("k").alias("a"), F.col("vec_id").alias("anchor_id"))
    return found.select("a", "positive_id", "positive_score").join(best, ["a", "positive_score"]).join(named, "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def turned(rows: DataFrame) -> DataFrame:
    """``rows`` whose label is moved on by one, of ten, where 7 divides the id."""
    return rows.select("vec_id", F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label")).alias("label"), "embedding")
