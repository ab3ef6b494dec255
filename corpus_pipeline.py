"""The corpus pipeline: each stage works on all rows that the one before it kept, written as Parquet and read again.

1. quality rules: documents that fail the base rules or the classifier go;
2. line dedup: repeated chunks of lines are cut out of the texts;
3. near-duplicates: one document of each component of similar documents stays (five words, similarity 0.8);
4. mixing: sources are drawn to their target weights, so documents of small sources may come repeatedly and those of large ones not at all;
5. encoding: ids and their decoding, as digests, of every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import bpe, lines, minhash, mixing, quality
from riskpanel.llm.common import table
from riskpanel.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_stage), ("line dedup", line_stage), ("near-duplicates", near_stage), ("mixing", mixing_stage),
    ("BPE encoding", encode_stage),
]
# The first stage fits a classifier, so no SQL text can say which documents it keeps; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``. Runs the stages before it when called."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage {i} {name}")
    return docs
