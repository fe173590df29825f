"""The queries opN_<name> of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, table
from . import bpe, chat, html_main, iblt, line_dedup, packing, quality, shards, simhash, sql, toxicity

#: Names of the tokenizer files, which lie in the folder of the installed package of public tokenizers.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, after deobfuscation."""
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the contiguous rank array."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate at its source."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text."""
    return iblt.fingerprint(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards in four arrivals, compacted, and read back by the newest manifest."""
    shard_table = shards.ShardTable(spark, fresh_path(spark, "shards"))
    shard_table.append_arrivals(table(spark, sf_dir, "documents"), F.spark_partition_id() % 4)
    shard_table.compact()
    shard_table.vacuum()
    return shard_table.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules' verdict on every document."""
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by SimHash and pigeonhole blocks."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_fingerprint": op4_fingerprint,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_sharding": op7_sharding,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": sql.LINE_DEDUP,
    "op6_chat": sql.CHAT,
    "op7_sharding": sql.SHARDING,
    "op9_quality": sql.QUALITY,
}
