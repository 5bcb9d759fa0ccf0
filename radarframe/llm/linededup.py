"""Line dedup: a line that several documents hold stays only in the one with the smallest id.

An index of line hashes is kept as levelled sorted runs, as a log-structured store does: every batch of documents brings
its distinct hashes, which are merge-joined with each run there is; hashes that a run has are known, and lose their lines
in the whole batch; the others are written as a new run, bucketed and sorted by hash, and lose their lines in all but
their first document. When a level has ``FANOUT`` runs, they are merged to one of the next level. Runs are disjoint and
lie in buckets, so that a join moves the batch's hashes and not the index. Batches come in ascending ids; a document
added later is later, whatever its id.

Only hashes (128 bits) and line numbers are shuffled, and the texts once, to meet the numbers of their lost lines. The lines of
frequent hashes are dealt by salts.

Defined cases: null and empty texts are one empty line; keys under ten code points never go; rows of one doc_id are one
document, rows without an id are one too, the last; repeated rows lose the same lines; a line that is repeated within its
first document stays there each time; very long texts are taken whole; an empty table gives an empty table; other
columns stay (:func:`deduplicated`) or are ignored (:func:`dedup_report`), whatever their names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS = 10
FANOUT, BATCHES = 2, 4
WHITE = " \t\n\x0b\f\r"
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """What lines are compared by: without white space at the ends, A-Z lower-cased."""
    return common.lower_az(F.btrim(line, F.lit(WHITE)))


def _rows(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """``docs`` with what names a row here: its document and the hash of its text."""
    return docs.withColumns({"__doc": F.coalesce(F.col(doc).cast("long"), F.lit(LAST)), "__t": F.xxhash64(common.text_of(text))})


def lines(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """__doc, __t, pos, h1, h2 of every line that counts."""
    cut = _rows(docs.select(F.col(doc), F.col(text)), text, doc).select("__doc", "__t", F.posexplode(F.split(common.text_of(text), "\n")).alias("pos", "__line"))
    keyed = cut.withColumn("__key", line_key(F.col("__line"))).where(F.char_length("__key") >= LEAST_CHARS)
    return keyed.select("__doc", "__t", "pos", F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(1), "__key").alias("h2"))


class LineIndex:
    """The runs in a shared folder. ``folder`` may hold those of an earlier index, which then goes on."""

    NAME = re.compile(r"run-(\d+)-(\d+)-([0-9a-f]+)$")

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or common.temporary(spark, "line-runs")
        self.tables: dict[str, str] = {}

    def runs(self) -> list[tuple[int, int, str]]:
        """(level, buckets, path) of the finished runs."""
        files, at = common._folder(self.spark, self.folder)
        if not files.exists(at):
            return []
        found = []
        for s in files.listStatus(at):
            path = s.getPath().toString()
            m = self.NAME.search(path)
            if m and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
                found.append((int(m[1]), int(m[2]), path))
        return sorted(found)

    def _name(self, path: str) -> str:
        return "line_run_" + re.sub("[^0-9a-z]", "_", path.rsplit("-", 1)[1])

    def _read(self, buckets: int, path: str) -> DataFrame:
        name = self._name(path)
        if path not in self.tables:
            self.spark.sql(f"create table if not exists {name} (h1 bigint, h2 bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {buckets} buckets location '{path}'")
            self.tables[path] = name
        return self.spark.table(name)

    def _write(self, hashes: DataFrame, level: int) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.folder}/run-{level}-{buckets}-{uuid.uuid4().hex}"
        name = self._name(path)
        hashes.select("h1", "h2").repartition(buckets, "h1", "h2").write.format("parquet").bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.tables[path] = name

    def _remove(self, path: str) -> None:
        if name := self.tables.pop(path, None):
            self.spark.sql(f"drop table if exists {name}")
        files, at = common._folder(self.spark, path)
        files.delete(at, True)

    def compact(self) -> None:
        """Merges the runs of every level that is full. Runs that a lost driver merged but didn't remove are merged again: they are sets."""
        level = 0
        while level <= max((k for k, _, _ in self.runs()), default=-1):
            full = [(b, p) for k, b, p in self.runs() if k == level]
            if len(full) >= self.fanout:
                merged = self._read(*full[0])
                for b, p in full[1:]:
                    merged = merged.unionByName(self._read(b, p))
                self._write(merged.distinct(), level + 1)
                for _, p in full:
                    self._remove(p)
            level += 1

    def add(self, docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
        """The lines that ``docs``, one batch, lose: __doc, __t and cut: array<int> of line numbers, from 0, as a staged table. Their new hashes join the index."""
        self.compact()
        rows = lines(docs, text, doc)
        keys = rows.groupBy("h1", "h2").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last"), F.count("*").alias("n"))
        known = F.lit(False)
        for k, (_, buckets, path) in enumerate(self.runs()):
            run = self._read(buckets, path).withColumn(f"__in{k}", F.lit(True))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(F.col(f"__in{k}"), F.lit(False))
        marked = common.staged(keys.select("h1", "h2", "first", "last", "n", known.alias("known")), "line-keys")
        total = marked.agg(F.sum("n")).first()[0] or 0
        self._write(marked.where("not known"), 0)
        # a hash of over a MOST_HOT-th of the lines is hot; so they are fewer than MOST_HOT
        limit = max(common.LEAST_HOT, total // common.MOST_HOT)
        lost = marked.where("known or first <> last")
        hot = F.broadcast(lost.where(F.col("n") > limit).select("h1", "h2", F.expr(f"cast(n div {limit} as int) + 1").alias("salts")))
        dealt = rows.join(hot, ["h1", "h2"], "left").withColumn("salt", F.expr("cast(pmod(xxhash64(__doc, __t, pos), coalesce(salts, 1)) as int)")).drop("salts")
        each = lost.select("h1", "h2", "first", "known", F.explode(F.expr(f"sequence(0, if(n > {limit}, cast(n div {limit} as int), 0))")).alias("salt"))
        gone = dealt.join(each, ["h1", "h2", "salt"]).where("known or __doc <> first")
        cuts = common.staged(gone.groupBy("__doc", "__t").agg(F.collect_set("pos").alias("cut")), "line-cuts")
        common.drop_staged(marked)
        return cuts

    def forget(self) -> None:
        """Removes all runs."""
        for _, _, path in self.runs():
            self._remove(path)

    def close(self) -> None:
        """Takes the runs out of the session's catalogue; they stay in their folder."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()


def _batches(docs: DataFrame, doc: str, batches: int) -> list[Column]:
    """Conditions that part ``docs`` into at most so many batches of about equal rows and ascending ids, those without one in the last."""
    at = docs.agg(F.percentile_approx(F.col(doc).cast("long"), [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    bounds = sorted(set(at))
    found = []
    for k in range(len(bounds) + 1):
        inside = F.lit(True)
        if k:
            inside = inside & (F.col(doc) >= bounds[k - 1])
        if k < len(bounds):
            inside = inside & (F.col(doc) < bounds[k])
        else:
            inside = inside | F.col(doc).isNull()
        found.append(inside)
    return found


def with_cuts(docs: DataFrame, text: str = "text", doc: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """``docs`` with __lines, the lines of the text, and __kept, the places of those that stay. What is in ``docs`` stays."""
    index, cuts = LineIndex(docs.sparkSession), None
    for inside in _batches(docs, doc, batches):
        more = index.add(docs.where(inside), text, doc)
        cuts = more if cuts is None else cuts.unionByName(more)
    index.forget()
    met = _rows(docs, text, doc).join(cuts, ["__doc", "__t"], "left").drop("__doc", "__t")
    met = met.withColumn("__lines", F.split(common.text_of(text), "\n"))
    return met.withColumn("__kept", F.expr("array_except(sequence(0, size(__lines) - 1), coalesce(cut, cast(array() as array<int>)))")).drop("cut")


def kept_text() -> Column:
    return F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")


def deduplicated(docs: DataFrame, text: str = "text", doc: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """``docs`` without the lines that an earlier document has; null texts stay null."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col(doc).alias("__id"), F.col(text).alias("__text"))
    done = with_cuts(held, "__text", "__id", batches)
    return done.select(*(F.when(F.col("__text").isNotNull(), kept_text()).alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def dedup_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    done = with_cuts(docs.select("doc_id", "text"), batches=batches)
    return done.select(
        "doc_id", F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256"),
    )
