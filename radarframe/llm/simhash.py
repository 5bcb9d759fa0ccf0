"""SimHash near-duplicates by the pigeonring principle.

A 64-bit fingerprint is cut into a ring of six segments. If two fingerprints differ in at most three
bits, then three segments agree, and from some segment on every chain of l consecutive segments differs
in at most l * 3 / 6 bits. Fingerprints meet on each triple of segments (20 keys of 31 to 33 bits),
chains prune what met, and the full Hamming check confirms. Only distinct fingerprints are linked, so
copies cost nothing; crowded keys are cut into blocks, and a block returns a spanning forest of its
links, not the pairs.

Defined cases: a null or empty text and one of white space only have fingerprint zero and are linked
like any other; a bit that exactly half of the hashes have is 0; texts of one or two words have one shingle, the whole sequence; repeated rows are rows
of their own in one component; rows with a null doc_id keep their fingerprint, count as largest when the
component's smallest doc_id is taken, and give null where no row of the component has one; a very long text's
shingles are counted as they stream by, and its fingerprint is of the whole of it. An empty table gives an empty table,
and other columns are ignored by :func:`fingerprints`, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
OFFSETS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS)))
BLOCK = 1024


def fingerprints(docs: DataFrame, size: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the narrow columns ``carried`` and fp (long) for each row of ``docs`` (doc_id, text).

    Bits are counted two to a long, in 32 sums, over the exploded hashes; a row's sums are complete before they are shuffled.
    """
    rows = docs.select("doc_id", *carried, "text", F.monotonically_increasing_id().alias("__row"))
    hashed = common.shingle_hashes(common.text_of(), size, "h", rows).select("__row", "doc_id", *carried, F.explode_outer("h").alias("h"))
    lanes = 0x1_0000_0001
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(lanes))).alias(f"s{k}") for k in range(32)]
    counted = hashed.groupBy("__row", "doc_id", *carried).agg(F.count("h").alias("n"), *sums)

    def bit(k: int) -> Column:
        s = F.col(f"s{k % 32}")
        ones = F.shiftrightunsigned(s, 32) if k >= 32 else s.bitwiseAND(F.lit(0xFFFF_FFFF))
        return F.when(ones * 2 > F.col("n"), F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0).cast("long"))

    return counted.select("doc_id", *carried, reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(64))).alias("fp"))


def _segment(fp: str, k: int) -> str:
    return f"(shiftrightunsigned({fp}, {OFFSETS[k]}) & {(1 << WIDTHS[k]) - 1}L)"


def _keys() -> Column:
    keys = []
    for t, (a, b, c) in enumerate(combinations(range(6), 3)):
        keys.append(f"(shiftleft({t}L, 40) | shiftleft({_segment('fp', a)}, {WIDTHS[b] + WIDTHS[c]}) | shiftleft({_segment('fp', b)}, {WIDTHS[c]}) | {_segment('fp', c)})")
    return F.expr(f"array({','.join(keys)})")


def _forest(batches):
    """Blocks, sorted by (key, x, y), to the links of a spanning forest of each."""
    import numpy as np
    import pyarrow as pa

    masks = [(np.uint64(o), np.uint64((1 << w) - 1)) for o, w in zip(OFFSETS, WIDTHS, strict=True)]

    def linked(x, y):
        apart = [np.bitwise_count(((x >> o) & m)[:, None] ^ ((y >> o) & m)[None, :]) for o, m in masks]
        ring = np.zeros(apart[0].shape, bool)
        for start in range(6):
            chain, whole = np.ones(ring.shape, bool), np.zeros(ring.shape, np.uint8)
            for length in range(1, 7):
                whole = whole + apart[(start + length - 1) % 6]
                chain &= whole * 6 <= length * BITS
                if not chain.any():
                    break
            ring |= chain
        i, j = np.nonzero(ring)
        near = np.bitwise_count(x[i] ^ y[j]) <= BITS
        return i[near], j[near]

    def links(rows):
        left, right = rows[~rows[:, 1].astype(bool), 0], rows[rows[:, 1].astype(bool), 0]
        same = not len(right)
        x, y = left.view(np.uint64), (left if same else right).view(np.uint64)
        i, j = linked(x, y)
        parent = list(range(len(x) + (0 if same else len(y))))

        def find(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        shift = 0 if same else len(x)
        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b + shift)
            if p != q:
                parent[q] = p
                out.append((a, b))
        ends = np.array(out, dtype=np.int64).reshape(-1, 2)
        return x[ends[:, 0]].view(np.int64), y[ends[:, 1]].view(np.int64)

    def made(parts):
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, parts, size = [], [], 0
    label = None

    def flush():
        nonlocal held
        rows = np.concatenate(held)
        held = []
        return links(rows)

    for batch in batches:
        key = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
        rows = np.stack([np.asarray(batch.column(3)), np.asarray(batch.column(4)).astype(np.int64)], axis=1)
        cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            here = tuple(key[lo])
            if held and here != label:
                parts.append(flush())
                size += len(parts[-1][0])
                if size > 50_000:
                    yield made(parts)
                    parts, size = [], 0
            label = here
            held.append(rows[lo:hi])
    if held:
        parts.append(flush())
    if parts:
        yield made(parts)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect just those distinct ``fp`` which chains of Hamming distance <= BITS connect."""
    keyed = prints.select("fp").distinct().select("fp", F.explode(_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = common.staged(sizes, "simhash-keys")
    apart = [f"bit_count({_segment('a', k)} ^ {_segment('b', k)})" for k in range(6)]
    chains = " or ".join(
        "(" + " and ".join(f"({' + '.join(apart[(s + j) % 6] for j in range(n))}) * 6 <= {n * BITS}" for n in range(1, 7)) + ")" for s in range(6)
    )
    two = sizes.where("n = 2").select("a", "b").distinct().where(chains).where(f"bit_count(a ^ b) <= {BITS}")

    many = keyed.join(sizes.where("n > 2").select("key", "n"), "key")
    many = many.withColumn("m", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)")).withColumn("c", F.expr("cast(pmod(xxhash64(fp), m) as int)"))
    blocks = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        "key", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "fp", (F.col("c") > F.col("o")).alias("right")
    )
    crowded = blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_forest, "a long, b long")
    return two.unionByName(crowded.where("a <> b")).distinct()


def _grouped(docs: DataFrame, least: Column, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The staged rows (doc_id, ``carried``, fp) of ``docs``, and fp, root and first of each distinct fingerprint: its component and the ``least`` of its rows.

    Copies meet in partial sums only, so a group of any size is a row for each of its distinct fingerprints from here on.
    """
    prints = common.staged(fingerprints(docs, carried=carried), "simhash")
    roots = common.components(links(prints)).withColumnRenamed("node", "fp")
    each = prints.groupBy("fp").agg(F.min(least).alias("first")).join(roots, "fp", "left")
    return prints, common.staged(each.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text): component_id is the smallest doc_id reachable."""
    prints, each = _grouped(docs.select("doc_id", "text"), F.col("doc_id"))
    smallest = each.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.spread_join(each.select("fp", "root"), smallest, ["root"]).select("fp", "component_id")
    return common.spread_join(prints, named, ["fp"]).select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, and of repeated rows the smallest hash of the text.

    Null doc_ids come last. Rows are told apart by hashes of all their columns but maps; of equal rows one is kept.
    """
    own = [c for c, kind in docs.dtypes if "map<" not in kind]
    keys = ("__text", "__key", "__check")
    keyed = docs.withColumns({"__text": F.xxhash64(common.text_of()), "__key": F.xxhash64(*own), "__check": F.hash(*own)})
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)
    _, each = _grouped(keyed.select("doc_id", "text", *keys), order, keys)
    keep = each.groupBy("root").agg(F.min("first").alias("first")).select("first.__key", "first.__check")
    return keyed.join(keep, ["__key", "__check"], "left_semi").dropDuplicates(["__key", "__check"]).select(*docs.columns)
