"""A training corpus from ``documents``: each stage works on all that the one before kept.

Quality and benchmark tables are read beside the documents; every stage but the last returns the
documents' own columns, and the last adds the piece ids of each text.

Defined cases: null and empty texts are rejected by the quality stage once a model is fitted (without labels of both classes
every document goes on); of repeated rows one stays, of null ids too; very long texts are taken whole by every stage; documents that tie
in a group are told apart by id, then by hashes; further columns, whatever their names, go through to the end, where ``piece_ids`` and ``decodes`` replace those of the same
name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from radarframe.llm import common, decontaminate, pieces, pii, quality, simhash
from radarframe.llm.queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return pii.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts encoded to SentencePiece ids, with a check that they decode."""
    return pieces.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encoding_stage),
]

#: Model scores, alignment and tokenization aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: each stage's documents are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, name)
            if k:  # what is written needs its input no more
                common.drop_staged(before)
    return docs
