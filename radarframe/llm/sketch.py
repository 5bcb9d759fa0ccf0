"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, so sketches of any two documents,
however unequal, are subsets of one sample of shingles: unions merge them, and shared shares estimate
containment. A text of at most ``FEW`` distinct shingles keeps them all, and says so by ``whole``. Two whole
sketches are compared exactly; otherwise both are cut to the fraction. A whole sketch may then be empty, and
its containment is null, unless the other's text is at hand (:func:`contained_in_text`, exact).

Defined cases: a null text is empty; texts without words have the empty sketch, whose likeness is 1 to
another empty one and else 0; fewer than five words are one shingle, the whole sequence. Rows with equal
doc_id follow each other in an order of their texts' hashes, null doc_ids come last, and repeated rows
stay. One document alone is its own next. Very long texts are fingerprinted whole. An empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: One in 2 ** FRACTION_BITS of the shingles is kept.
FRACTION_BITS = 3
#: Texts of at most so many distinct shingles keep all.
FEW = 128
SEGMENTS, BUCKET_ROWS, MOST_BUCKETS = 64, 512, 262_144
#: Texts of about so many bytes are dealt to a task, however many tasks the session asks for, while there are not more tasks than this.
PART_BYTES, MOST_PARTS = 8_000_000, 100_000
LEAST = -(2**63)


def _below(hashes: str) -> str:
    return f"filter({hashes}, h -> h < {1 << (63 - FRACTION_BITS)}L)"


def _hashed(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """``docs`` with ``out``: the distinct 63-bit hashes of ``text``'s shingles."""
    return common.shingle_hashes(text, WORDS, out, docs).withColumn(out, F.expr(f"array_distinct(transform({out}, h -> h & 9223372036854775807L))"))


def _cut(hashes: Column) -> Column:
    """The sketch of the text with these distinct hashes."""
    return F.transform(F.array(hashes), lambda x: F.struct((F.size(x) <= FEW).alias("whole"), F.array_sort(F.when(F.size(x) <= FEW, x).otherwise(F.filter(x, lambda h: h < (1 << (63 - FRACTION_BITS))))).alias("hashes")))[0]


def sketched(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """``docs`` with ``out``: whether ``text``'s sketch is whole, and its sorted distinct hashes."""
    return _hashed(docs, text, "__h").withColumn(out, _cut(F.col("__h"))).drop("__h")


def _common(a: str, b: str) -> tuple[Column, Column]:
    """The hashes of two sketches under the threshold they have in common."""
    both = f"{a}.whole and {b}.whole"
    return tuple(F.expr(f"case when {both} then {x}.hashes else {_below(f'{x}.hashes')} end") for x in (a, b))


def likeness(a: str, b: str) -> Column:
    """Jaccard estimate of two sketches."""
    x, y = _common(a, b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.when(F.expr(f"size({a}.hashes) = size({b}.hashes)"), 1.0).otherwise(0.0))


def containment(a: str, b: str) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; null where nothing of ``a`` is below the common threshold."""
    x, y = _common(a, b)
    return F.when(F.size(f"{a}.hashes") == 0, 1.0).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def contained_in_text(docs: DataFrame, a: str, b: str, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: :func:`containment`, but from all shingles of ``b``'s ``text`` where only ``a`` is whole."""
    part = f"{a}.whole and not {b}.whole and size({a}.hashes) > 0"
    exact = F.size(F.array_intersect(f"{a}.hashes", "__all")) / F.size(f"{a}.hashes")
    return _hashed(docs, F.expr(f"case when {part} then {text} else '' end"), "__all").withColumn(out, F.when(F.expr(part), exact).otherwise(containment(a, b))).drop("__all")


def merged(sketches: Column) -> Column:
    """The sketch of several documents together, from an array of theirs."""
    union = F.array_sort(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["hashes"]))))
    whole = F.forall(sketches, lambda s: s["whole"]) & (F.size(union) <= FEW)
    return F.struct(whole.alias("whole"), F.when(whole, union).otherwise(F.filter(union, lambda h: h < (1 << (63 - FRACTION_BITS)))).alias("hashes"))


def printed(sketch: str) -> Column:
    return F.lower(F.array_join(F.transform(f"{sketch}.hashes", lambda h: F.hex(h)), ","))


def _bucket(key: str, knots: list[int], per: int) -> Column:
    """Buckets that ascend with ``key``: quantile segments, each cut evenly."""
    lows, highs = [f"{x}L" for x in knots[:-1]], [f"{x}L" for x in knots[1:]]
    return F.expr(
        f"case when {key} < {lows[0]} then -1 else __seg * {per} + cast(least({per - 1}, floor(({key} - get(array({','.join(lows)}), __seg))"
        f" / (1.0D + get(array({','.join(highs)}), __seg) - get(array({','.join(lows)}), __seg)) * {per})) as int) end"
    )


def with_next(docs: DataFrame, order: str, carried: list[str], size: Column | None = None) -> DataFrame:
    """``docs`` with next_<c> for each of ``carried``: that of the next row in descending ``order``, after the last the first's.

    One shuffle of the rows, by buckets of ``order``; the first row of each lower bucket is sent along as a
    guest. Only the buckets' bounds, of bounded number, are gathered. ``size`` is a row's bytes, by which buckets are dealt to tasks.
    """
    keyed = docs.withColumn("__k", F.coalesce(order, F.lit(LEAST)))
    got = keyed.where(f"{order} is not null").agg(
        F.count("*").alias("n"), F.percentile_approx(order, [k / SEGMENTS for k in range(SEGMENTS + 1)], 10_000).alias("q"), F.min(order).alias("lo"),
    ).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size is not None:
        parts = min(MOST_PARTS, (docs.agg(F.sum(size)).first()[0] or 0) // PART_BYTES + 1)
    knots = sorted({*(got["q"] or [0]), got["lo"] or 0})
    knots = knots if len(knots) > 1 else [knots[0], knots[0] + 1]
    per = max(1, min(MOST_BUCKETS, got["n"] // BUCKET_ROWS + 1) // (len(knots) - 1))

    def bucketed(df: DataFrame) -> DataFrame:
        seg = F.least(F.greatest(common.range_index("__k", knots) - 1, F.lit(0)), F.lit(len(knots) - 2))
        return df.withColumn("__seg", seg).withColumn("__b", _bucket("__k", knots, per)).drop("__seg")

    tops = bucketed(keyed.select("__k")).groupBy("__b").agg(F.max("__k").alias("top"))
    over = Window.orderBy("__b")  # one row a bucket
    tops = tops.withColumn("below", F.lag("top").over(over)).withColumn("most", F.max("top").over(Window.partitionBy()))
    guests = tops.select("__b", F.explode(F.array(F.struct(F.col("below").alias("k"), F.lit(0).alias("wrap")), F.when(F.col("below").isNull(), F.struct(F.col("most").alias("k"), F.lit(1).alias("wrap"))))).alias("g"))
    guests = guests.where("g.k is not null").groupBy(F.col("g.k").alias("__k")).agg(F.collect_list(F.struct("__b", F.col("g.wrap").alias("wrap"), F.lit(True).alias("guest"))).alias("__guests"))

    own = F.array(F.struct("__b", F.lit(0).alias("wrap"), F.lit(False).alias("guest")))
    sent = bucketed(keyed).join(F.broadcast(guests), "__k", "left")
    sent = sent.withColumn("__to", F.explode(F.concat(own, F.coalesce("__guests", F.expr("cast(array() as array<struct<__b:int,wrap:int,guest:boolean>>)"))))).drop("__guests", "__b")
    sent = sent.select("*", "__to.*").drop("__to")
    # neighbouring buckets share a task, about as many in each
    buckets = per * (len(knots) - 1)
    sent = sent.withColumn("__part", F.expr(f"cast(greatest(cast(__b as long), 0) * {parts} div {buckets} as int)")).repartitionById(parts, "__part")
    w = Window.partitionBy("__part", "__b").orderBy("wrap", F.desc("__k"), F.xxhash64(*carried))
    led = sent.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return led.where("not guest").drop("__k", "__b", "__part", "wrap", "guest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and containments."""
    rows = sketched(docs.select("doc_id", common.text_of().alias("text")), F.col("text"), "sketch")
    led = with_next(rows, "doc_id", ["text", "sketch"], F.octet_length("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    led = sketched(led.withColumn("edited", edited), F.col("edited"), "edited_sketch")
    led = contained_in_text(led, "sketch", "edited_sketch", "edited", "contained_edited")
    led = contained_in_text(led, "sketch", "next_sketch", "next_text", "contained_next")
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("sketch").alias("fingerprint"), printed("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        "contained_edited", "contained_next",
    )
