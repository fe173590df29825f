"""What several of the operators share: words and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; an empty array for null and for texts without a word."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex64(value: Column) -> Column:
    """Sixteen lowercase hex digits of a long."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def shingles(docs: DataFrame, keep: list[Column], text: Column, width: int) -> DataFrame:
    """The columns kept, and beside them h array<long>: XXH64 (seed 42) of the text's shingles, repeats included.

    A shingle is `width` words of the text with A-Z lowered, joined by spaces. A text of fewer words is one shingle, one
    without words (null, empty, blank) has none.
    """
    w, i = F.col("_w"), F.col("_n") - width
    runs = F.transform(F.sequence(F.lit(0), i), lambda k: F.xxhash64(F.concat_ws(" ", *[F.get(w, k + j) for j in range(width)])))
    listed = docs.select(*keep, words(lower_ascii(text)).alias("_w")).withColumn("_n", F.size("_w"))
    none = F.array().cast("array<bigint>")
    h = F.when(F.col("_n") == 0, none).when(i < 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(runs)
    return listed.withColumn("h", h).drop("_w", "_n")
