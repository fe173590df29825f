"""The pipeline over `documents`: each stage works on all that the one before it kept.

Toxic documents go, then those that the quality rules reject; lines that are boilerplate at their source are taken out
of the texts; of each group of near copies one document stays; what is left is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import line_dedup, packing, quality, simhash, toxicity
from tracewright.llm.registry import WORD_BPE, tokenizer
from tracewright.session import fresh_path, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer(WORD_BPE))


#: (name, function of (spark, docs, sf_dir)), in order. What a stage returns is written as Parquet and read by the next.
STAGES = [
    ("toxicity", _toxicity),
    ("quality_rules", _quality),
    ("line_dedup", _line_dedup),
    ("near_dedup", _near_dedup),
    ("packing", _packing),
]

#: Learned scores and the vocabulary's merges are beyond SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = fresh_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
