"""Quality by compression: Zstandard dictionaries of good and of bad labelled text.

A text is cut into chunks, each compressed with either dictionary; the normalised difference of the
summed sizes becomes a score by a logistic curve fitted on labelled rows that built neither dictionary.
The curve also sees how far the text shrinks at all, since endless repetition shrinks alike with both.

The model is fitted on a bounded sample: of either class the first ``SAMPLE`` rows in the order of a hash, as far as their texts
come to ``SAMPLE_BYTES``, each whole. Scores read whole texts.

Defined cases: a null text is empty; an empty text shows no quality and scores 0, where there is a model; rows are
scored each on its own, so ties and repeated rows don't matter, and of repeated labels the better one counts; without labelled
rows of both classes every score is 0.5; an empty table gives an empty table. Labels that are null, or whose rows have no
document, are left out; further columns of the input stay, the added ones replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES = 2000, 32_000_000
DICTIONARY_BYTES, CHUNK, LEVEL = 65_536, 1024, 3
THRESHOLD = 0.3


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """A function of a text; compressors are made where it is called."""
        import zstandard

        if not self.good:
            return lambda text: 0.5
        pair = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            pair.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        return lambda text: logistic(self.weights, features(text, *pair)) if text else 0.0


def features(text: str | None, good, bad) -> tuple[float, ...]:
    """(bad - good) / (bad + good) of the compressed sizes, over 0 if the good dictionary serves better; and
    the logarithm of the smaller size to the text's, with its square."""
    import math

    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0, 0.0, 0.0
    g = b = 0
    for k in range(0, len(data), CHUNK):
        part = data[k : k + CHUNK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    shrunk = math.log(min(g, b) / len(data))
    return (b - g) / (b + g), shrunk, shrunk * shrunk


def logistic(weights: tuple[float, ...], x: tuple[float, ...]) -> float:
    import math

    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, weights[0] + sum(w * v for w, v in zip(weights[1:], x, strict=True))))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``labels`` (doc_id, quality) of rows that aren't held out."""
    import zstandard

    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    rows = set()
    for q in (0, 1):  # a class' labels, then their documents' rows
        ids = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE)
        own = docs.select("doc_id", common.text_of().alias("text")).where("text <> ''").join(F.broadcast(ids), "doc_id")
        rows |= {(r["doc_id"], q, r["text"]) for r in common.bounded_sample(own, F.xxhash64("doc_id", "text"), F.octet_length("text"), SAMPLE, SAMPLE_BYTES)}
    rows = sorted(rows)
    by = {q: [(i, t) for i, x, t in rows if x == q] for q in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        return Model(b"", b"", ())

    def dictionary(texts: list[str]) -> bytes:
        whole = (t.encode("utf-8", "surrogatepass") for t in texts)
        parts = [t[k : k + CHUNK] for t in whole for k in range(0, len(t), CHUNK)]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little text to choose from: its end is the dictionary
            return b"".join(parts)[-DICTIONARY_BYTES:] or b" " * 8

    made = [dictionary([t for k, (_, t) in enumerate(by[q]) if k % 2 == 0]) for q in (1, 0)]
    pair = []
    for raw in made:
        held = zstandard.ZstdCompressionDict(raw)
        held.precompute_compress(level=LEVEL)
        pair.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    xs, ys, ws = [], [], []
    for q in (0, 1):
        rest = [t for k, (_, t) in enumerate(by[q]) if k % 2 == 1]
        xs += [features(t, *pair) for t in rest]
        ys += [q] * len(rest)
        ws += [sizes[q] / len(rest)] * len(rest)  # classes in the proportion of the labels
    return Model(*made, calibrated(xs, ys, ws))


def calibrated(xs: list[tuple[float, ...]], ys: list[int], ws: list[float]) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method with a small ridge: the constant, then a weight a feature."""
    import numpy as np

    x, y, w = (np.array(v, float) for v in (xs, ys, ws))
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.concatenate([np.ones((len(x), 1)), x / scale], 1)
    w = w / w.sum() * len(w)
    beta = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - 1e-1 * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-1 * np.eye(len(beta))
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return (float(beta[0]), *(float(b) for b in beta[1:] / scale))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    common.small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index("text")

    def score(batches):
        import pyarrow as pa

        rate = model.scorer()
        for batch in batches:
            values = pa.array([rate(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*kept, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.select(*kept).schema.fields, StructField("score", DoubleType())])
    return docs.select(*kept).mapInArrow(score, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    done = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with their own columns."""
    done = scored(docs.withColumn("__own", F.col("score")) if "score" in docs.columns else docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
    return done.withColumnRenamed("__own", "score").select(*docs.columns)
