"""Sharding by sampled splitters: near equal bytes, equal texts together, gapless slots.

Keys are hashes of texts, so equal texts have one key. A size-weighted sample of keys gives quantile
splitters; the ranges between them are counted exactly, and running bytes cut them into shards. A key
heavier than ``WHOLE`` of a shard is placed by itself, largest first, on the shard with most room; a key
heavier than a whole shard is an overfull range and is subdivided row by row before it is cut. What
reaches the driver is one row a range or heavy key, both of bounded number.

Defined cases: a null text has size 16 and crc32 0 and the empty text's key; null doc_ids come first in
their group; repeated rows, and rows with equal or null ids, keep a slot each and are subdivided like others; rows that tie in
everything get their slots in any order. A very long text is one row of its size, which a shard may hold alone.
An empty table gives an empty table. Other columns are dropped by :func:`assign_shards`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Ranges of keys: one for about ``RANGE_ROWS`` rows, between these numbers, with ``SAMPLES`` sampled keys each.
RANGES, MOST_RANGES, RANGE_ROWS, SAMPLES = 512, 4096, 1_000_000, 40
#: Of a shard's bytes: lighter keys are laid out by range.
WHOLE = 0.01
PARTS = 400


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = common.text_of()
    rows = common.staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            # a row's own number, fixed by the table that is staged here: repeated rows and ids have different ones
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int").alias("mix"),
        ),
        "shard-rows",
    )
    sums = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, ranges = sums["size"] or 0, min(MOST_RANGES, max(RANGES, sums["n"] // RANGE_ROWS))
    room = max(1.0, total / shards)
    # a key of over WHOLE of a shard: at most shards / WHOLE of them
    heavy = [
        (r.key, r.bytes)
        for r in rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > WHOLE * room).orderBy(F.desc("bytes"), "key").collect()
    ]
    alone, split = [h for h in heavy if h[1] <= room], [h for h in heavy if h[1] > room]

    chance = F.expr("pmod(xxhash64(mix, key, 11), 1000000007) / 1000000007.0D")
    sample = rows.where(chance < F.col("size") * (SAMPLES * ranges / max(1, total)))
    bounds = sample.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or []
    bounds = sorted(set(bounds))

    # ranges: below zero for keys that stay alone, then those of the splitters, then the parts of split keys
    spark = rows.sparkSession
    named = spark.createDataFrame(
        [(k, -1 - i, 1) for i, (k, _) in enumerate(alone)] + [(k, len(bounds) + 1 + i * PARTS, PARTS) for i, (k, _) in enumerate(split)],
        "key long, first int, parts int",
    )
    ranged = (
        rows.join(F.broadcast(named), "key", "left")
        .withColumn("range", F.when(F.col("first").isNull(), common.range_index("key", bounds)).otherwise(F.col("first") + F.expr("cast(mix * cast(parts as long) div 1048576 as int)")))
        .drop("first", "parts")
    )

    sums = dict(ranged.groupBy("range").agg(F.sum("size").alias("b")).collect())
    left = [room] * shards
    placed: dict[int, int] = {}
    for i, (_, b) in enumerate(alone):
        k = max(range(shards), key=lambda j: (left[j], -j))
        placed[-1 - i], left[k] = k, left[k] - b
    left = [max(0.0, x) for x in left]
    light = sum(b for r, b in sums.items() if r >= 0)
    scale = light / max(1e-9, sum(left))
    edges, at = [], 0.0
    for x in left[:-1]:
        edges.append(int(at := at + x * scale))
    before, at = {}, 0
    for r in sorted(r for r in sums if r >= 0):
        before[r], at = at, at + sums[r]
    table = spark.createDataFrame([(r, before.get(r, 0), placed.get(r)) for r in sums], "range int, before long, alone int")

    # all rows of a key in a range see the same running sum, so they fall to one shard; rows of a subdivided key go one by one
    split_range = F.col("range") > len(bounds)
    per_key = ranged.groupBy("range", "key", F.when(split_range, F.col("mix")).alias("unit")).agg(F.sum("size").alias("b"))
    w = Window.partitionBy("range").orderBy("key", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        per_key.withColumn("run", F.sum("b").over(w))
        .join(F.broadcast(table), "range")
        .withColumn("middle", F.expr("before + run - b div 2"))
        .withColumn("shard", F.coalesce("alone", common.range_index("middle", edges)))
        .select("range", "key", "unit", "shard")
    )
    cut = common.staged(cut, "shard-cuts")
    on = ["range", "key", "unit"]
    full = common.staged(
        ranged.withColumn("unit", F.when(split_range, F.col("mix"))).join(
            cut.select("range", F.col("key").alias("k2"), F.col("unit").alias("u2"), "shard").withColumnRenamed("range", "r2"),
            (F.col("range") == F.col("r2")) & (F.col("key") == F.col("k2")) & F.col("unit").eqNullSafe(F.col("u2")),
        ).select("doc_id", "size", "text_crc32", "mix", *on, "shard"),
        "sharded",
    )
    # slots: rank in a piece of a shard, after the pieces before it; rows of a lone key are pieces by row hash
    piece = F.when(F.col("range") < 0, F.col("range") * 64 - F.expr("mix div 16384")).otherwise(F.col("range"))
    full = full.withColumn("piece", piece)
    counts = full.groupBy("shard", "piece").count().collect()
    offsets, seen = [], [0] * shards
    for r in sorted(counts):
        offsets.append((r["shard"], r["piece"], seen[r["shard"]]))
        seen[r["shard"]] += r["count"]
    offsets = spark.createDataFrame(offsets, "shard int, piece int, first long")
    rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("key", "doc_id"))
    return full.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")
    )


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """What :func:`assign_shards` gives, with the law it holds: ``bytes``, sizes of shards near equal."""
    return assign_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
