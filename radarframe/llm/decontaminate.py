"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are three words of a test item, in a row or with the third one word further on. In how many documents each is found is counted over the
whole corpus first. A rare one, in at most ``RARE_LEAST`` documents or ``RARE_SHARE`` of all, proposes a passage wherever it is found: so an edited copy
is aligned if anywhere in it two neighbouring words and one of the next two are left, whatever its edits broke beside them. A common one, such as
a turn of phrase, proposes one only beside another seed of the item, of other words, about as far from its place in the item. Of a passage, the words
can't align better than all words of the item that stand among them, repeated ones each time; where that is enough, they are aligned with the item, once
for each stretch of a document however many seeds are found there.

Workers look seeds up and align passages where the documents lie, so no text is shuffled, and documents that hold the same
passage weigh on no one task. The benchmark is taken in blocks of at most ``BLOCK_GRAMS`` seeds (an item longer than that is a block of its own), so what is
broadcast, the items' words, their seeds and counts, has a bound and every item is still tried.

A document leaks an item if the alignment scores ``THRESHOLD`` of an exact copy with at least ``LEAST_WORDS`` words
(or all of a shorter item), or if it scores as ``LONG_RUN`` words in a row do, however long the item.

Words are lower-cased runs of letters and digits. Defined cases: null texts are empty; an item of fewer
than three words has no seed and matches nothing; null ids are ids like others; repeated
documents give equal rows, of which one is kept for each doc_id, text and item; of repeated item_ids each text is tried, and the best
kept; of alignments that tie, that which starts first counts. A very long document is cut into windows around its meetings, each aligned by itself; an
empty table on either side finds nothing. Other columns are ignored by :func:`find_leaks` and kept by :func:`decontaminated`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Where the words of a seed stand.
SEEDS = ((0, 1, 2), (0, 1, 3))
BLOCK_GRAMS = 1_000_000
#: A seed is rare that is in at most so many documents, or this share of all.
RARE_LEAST, RARE_SHARE = 50, 1e-4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of the score of an exact copy.
THRESHOLD = 0.4
#: Of items of more words, one trigram isn't enough; and an alignment worth so many words in a row is, however long the item.
LEAST_WORDS, LONG_RUN = 4, 25
#: Cells of one row of the score tables that are filled together.
CELLS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


class Seeds:
    """A block's items and their seeds, by number: what a worker looks up."""

    def __init__(self, items: list):
        import numpy as np

        self.ids, self.words = [r["item_id"] for r in items], [list(r["item"]) for r in items]
        self.hashes = [np.array(r["hashes"], np.int64) for r in items]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.slack = np.maximum(8, self.sizes // 2)
        self.again = np.array([len(w) - len(set(w)) for w in self.words], np.int64)
        self.enough = np.maximum(np.minimum(LONG_RUN, THRESHOLD * self.sizes), np.minimum(LEAST_WORDS, self.sizes))
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        gram, where = grams(np.concatenate(self.hashes), np.diff(starts))
        owner = np.searchsorted(starts, where, "right") - 1
        order = np.argsort(gram, kind="stable")
        self.grams, first = np.unique(gram[order], return_index=True)
        # of each seed: the items that have it, and at which word
        self.first = np.concatenate([first, [len(gram)]])
        self.item, self.place = owner[order], (where - starts[owner])[order]
        self.bits = np.zeros(1 << 20, bool)  # most words of a corpus start no seed, which their first bits tell
        self.bits[self.grams >> 44] = True
        self.rare = np.ones(len(self.grams), bool)

    def found(self, hashes, sizes) -> tuple:
        """Numbers of the seeds in documents that follow each other, and the words they begin at."""
        import numpy as np

        gram, where = grams(hashes, sizes)
        some = np.nonzero(self.bits[gram >> 44])[0]
        at = np.searchsorted(self.grams, gram[some])
        at[at == len(self.grams)] = 0
        same = self.grams[at] == gram[some] if len(self.grams) else np.zeros(len(at), bool)
        return at[same], where[some[same]]


def grams(hashes, sizes) -> tuple:
    """Hashes of the seeds of texts that follow each other, given their words' hashes, and the words they begin at."""
    import numpy as np

    end = np.repeat(np.cumsum(sizes), sizes)
    out, where = [], []
    words = hashes.view(np.uint64)
    for k, places in enumerate(SEEDS):
        at = np.nonzero(np.arange(len(hashes)) + places[-1] < end)[0]
        with np.errstate(over="ignore"):
            value = np.full(len(at), k + 1, np.uint64)
            for j in places:
                value = (value ^ words[at + j]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
        out.append(value >> np.uint64(1))
        where.append(at)
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, score (of an exact copy's), matched, start for each document and item that align."""
    common.small_batches(docs.sparkSession)
    items = benchmark.select("item_id", tokens(common.text_of()).alias("item")).where(f"size(item) >= {SEEDS[0][-1] + 1}").distinct().withColumn("key", F.xxhash64("item_id", "item"))
    n = items.agg(F.sum(F.size("item"))).first()[0] or 0
    blocks = max(1, -(-n * len(SEEDS) // BLOCK_GRAMS))
    rows = docs.select("doc_id", F.xxhash64(common.text_of()).alias("text_hash"), tokens(common.text_of()).alias("words")).withColumn("hashes", hashed("words"))
    best = None
    for k in range(blocks):
        part = _block_leaks(rows, items if blocks == 1 else items.where(F.expr(f"pmod(xxhash64(key), {blocks}) = {k}")), dict(benchmark.dtypes)["item_id"])
        best = part if best is None else best.unionByName(part)
    best = best.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("score", "matched", (-F.col("start")).alias("back"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", "b.score", "b.matched", (-F.col("b.back")).alias("start"))


def hashed(words: str) -> Column:
    return F.expr(f"transform({words}, w -> xxhash64(w))")


def _documents(batch, at: int):
    """Of a column of lists: their values one after the other, and the lists' sizes."""
    import numpy as np

    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def document_counts(rows: DataFrame, seeds: Seeds) -> tuple[dict[int, int], int]:
    """In how many documents each of a block's seeds is found, and how many there are. Tasks add theirs up; the seeds of a block are of bounded number."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen, n = np.zeros(len(seeds.grams), np.int64), 0
        for batch in batches:
            hashes, sizes = _documents(batch, 0)
            at, where = seeds.found(hashes, sizes)
            doc = np.searchsorted(np.cumsum(sizes), where, "right")
            seen += np.bincount(np.unique(doc * max(1, len(seen)) + at) % max(1, len(seen)), minlength=len(seen))[: len(seen)]
            n += batch.num_rows
        some = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["seed", "n"])

    found = dict(rows.select("hashes").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n")).collect())
    return found, found.pop(-1, 0)


def proposed(seeds: Seeds, hashes, sizes) -> tuple:
    """Documents, items and first words of the stretches that a rare seed, or two seeds of other words, propose: each once."""
    import numpy as np

    at, where = seeds.found(hashes, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.searchsorted(starts[1:], where, "right")
    many = seeds.first[at + 1] - seeds.first[at]
    hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - seeds.first[at], many)
    item, place, rare = seeds.item[hit], seeds.place[hit], np.repeat(seeds.rare[at], many)
    doc = np.repeat(doc, many)
    begin = np.repeat(where, many) - starts[doc] - place  # where the item's first word would stand
    slack = seeds.slack[item]
    good = rare.copy()
    if not rare.all():
        apart = max(p[-1] for p in SEEDS) + 1
        for shift in (0, slack // 2):
            order = np.lexsort((place, (begin + shift) // slack, item, doc))
            d, i, c, q = doc[order], item[order], ((begin + shift) // slack)[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (c[1:] != c[:-1])
            first = np.nonzero(new)[0]
            last = np.append(first[1:], len(order)) - 1
            wide = q[last] - q[first] >= apart if len(order) else np.zeros(0, bool)
            good[order] |= np.repeat(wide, last - first + 1)
    doc, item, begin, slack = doc[good], item[good], begin[good], slack[good]
    order = np.lexsort((begin, begin // slack, item, doc))
    doc, item, begin, cell = doc[order], item[order], begin[order], (begin // slack)[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
    return doc[new], item[new], begin[new], starts


def _block_leaks(rows: DataFrame, items: DataFrame, item_kind: str) -> DataFrame:
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, item_id {item_kind}, score double, matched int, start int"
    block = items.withColumn("hashes", hashed("item")).select("item_id", "item", "hashes").collect()  # bounded by BLOCK_GRAMS
    if not block:
        return spark.createDataFrame([], schema)
    seeds = Seeds(block)
    counts, documents = document_counts(rows, seeds)
    most = max(RARE_LEAST, int(RARE_SHARE * documents))
    for k, n in counts.items():
        seeds.rare[k] = n <= most
    held = spark.sparkContext.broadcast(seeds)
    item_type = items.select("item_id").schema[0].dataType

    def align(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        seeds = held.value
        for batch in batches:
            hashes, sizes = _documents(batch, 3)
            docs, which, begin, starts = proposed(seeds, hashes, sizes)
            words = batch.column(2).flatten()
            rows, items_, passages, firsts, numbers = [], [], [], [], []
            for d, i, b in zip(docs.tolist(), which.tolist(), begin.tolist(), strict=True):
                slack, n = int(seeds.slack[i]), int(seeds.sizes[i])
                lo = max(0, b - slack)
                hi = min(int(sizes[d]), lo + n + 3 * slack)
                a = int(starts[d])
                if np.isin(np.unique(seeds.hashes[i]), hashes[a + lo : a + hi]).sum() + seeds.again[i] < seeds.enough[i]:
                    continue
                rows.append(d)
                numbers.append(i)
                items_.append(seeds.words[i])
                firsts.append(lo)
                passages.append(words.slice(a + lo, hi - lo).to_pylist())
            hopeful = [k for k, s in enumerate(best_scores(items_, passages)) if leaked(s, LEAST_WORDS, len(items_[k]))]
            out = [(k, *smith_waterman(items_[k], passages[k])) for k in hopeful]
            out = [x for x in out if leaked(x[1], x[2], len(items_[x[0]]))]
            own = batch.select([0, 1]).take(pa.array([rows[x[0]] for x in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([
                *own.columns, pa.array([seeds.ids[numbers[k]] for k, *_ in out], to_arrow_type(item_type)), pa.array([s / (MATCH * len(items_[k])) for k, s, _, _ in out], pa.float64()),
                pa.array([m for _, _, m, _ in out], pa.int32()), pa.array([firsts[k] + b for k, _, _, b in out], pa.int32()),
            ], names=["doc_id", "text_hash", "item_id", "score", "matched", "start"])

    return rows.select("doc_id", "text_hash", "words", "hashes").mapInArrow(align, schema)


def leaked(score: int, matched: int, words: int) -> bool:
    """Whether an alignment with an item of so many words is a copy of it or of a long run of it."""
    return score >= MATCH * LONG_RUN or score >= THRESHOLD * MATCH * words and matched >= min(words, LEAST_WORDS)


def best_scores(items: list[list[str]], passages: list[list[str]]) -> list[int]:
    """The best local alignment score of each pair of word lists, many tables at a time: a row of them for a word of the items."""
    import numpy as np

    out = [0] * len(items)
    order = sorted(range(len(items)), key=lambda k: (len(passages[k]), len(items[k])))
    while order:
        some: list[int] = []
        while order and (not some or (len(some) + 1) * (len(passages[order[-1]]) + 1) <= CELLS and len(some) * len(passages[some[0]]) <= CELLS):
            some.append(order.pop())
        known: dict[str, int] = {}
        wide, long = max(len(passages[k]) for k in some), max(len(items[k]) for k in some)
        a, b = np.full((len(some), long), -1), np.full((len(some), wide), -2)
        for i, k in enumerate(some):
            a[i, : len(items[k])] = [known.setdefault(w, len(known)) for w in items[k]]
            b[i, : len(passages[k])] = [known.setdefault(w, len(known)) for w in passages[k]]
        step = GAP * np.arange(1, wide + 1)
        above, best = np.zeros((len(some), wide + 1), int), np.zeros(len(some), int)
        for j in range(long):
            here = np.zeros_like(above)
            cell = np.maximum(above[:, :-1] + np.where(a[:, j : j + 1] == b, MATCH, MISMATCH), above[:, 1:] + GAP)
            np.maximum(cell, 0, out=cell)
            # gaps along the passage: the best cell to the left, less a gap for each word between
            here[:, 1:] = np.maximum.accumulate(cell - step, axis=1) + step
            above = here
            if wide:
                best = np.maximum(best, here.max(axis=1))
        for i, k in enumerate(some):
            out[k] = int(best[i])
    return out


def smith_waterman(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Best local alignment score of two word lists, its matching words, and its first word in ``passage``."""
    width = len(passage) + 1
    score, came = [0] * width, [(0, j) for j in range(width)]
    best = (0, 0, 0)
    for word in item:
        row, from_ = [0] * width, [(0, 0)] * width
        for j in range(1, width):
            same = word == passage[j - 1]
            up = score[j - 1] + (MATCH if same else MISMATCH)
            gap_item, gap_passage = score[j] + GAP, row[j - 1] + GAP
            if up > 0 and up >= gap_item and up >= gap_passage:
                m, s = came[j - 1] if score[j - 1] else (0, j - 1)
                row[j], from_[j] = up, (m + same, s)
            elif gap_item > 0 and gap_item >= gap_passage:
                row[j], from_[j] = gap_item, came[j]
            elif gap_passage > 0:
                row[j], from_[j] = gap_passage, from_[j - 1]
            if row[j] > best[0]:
                best = (row[j], *from_[j])
        score, came = row, from_
    return best


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that align with no test item."""
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(common.text_of()) == F.col("__hash")), "left_anti")
