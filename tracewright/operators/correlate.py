"""Correlation of cases over shared indicators and near digests, and the campaigns that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: Kinds of indicators of which one suffices, and the bits that near digests differ in at most.
STRONG = ["ip", "sender", "domain", "replyto", "urlhost", "file"]
FUZZY_BITS = 12


def kind(indicator: Column) -> Column:
    return F.substring_index(indicator, ":", 1)


def is_strong(indicator: Column) -> Column:
    return kind(indicator).isin(*STRONG)


def shared(indicators: DataFrame) -> DataFrame:
    """(a, b, strong, weak) of each pair of cases that share indicators, a < b: an equality self-join on the indicator."""
    one = indicators.select("email_id", "indicator").distinct()
    pairs = one.select(F.col("email_id").alias("a"), "indicator").join(one.select(F.col("email_id").alias("b"), "indicator"), "indicator").where("a < b")
    strong = is_strong(F.col("indicator"))
    return pairs.groupBy("a", "b").agg(F.count_if(strong).alias("strong"), F.count_if(~strong).alias("weak"))


def related(indicators: DataFrame) -> DataFrame:
    """Pairs with a strong indicator in common, or two weak ones."""
    return shared(indicators).where("strong >= 1 or weak >= 2")


def links(indicators: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of related(), without its pairs where a strong indicator makes them all.

    All cases of a strong indicator are related, so each is linked to the first of them: a hot indicator gives as many
    edges as it has cases. Only weak indicators need pairs.
    """
    one = indicators.select("email_id", "indicator").distinct()
    strong = one.where(is_strong(F.col("indicator")))
    first = strong.groupBy("indicator").agg(F.min("email_id").alias("a"))
    stars = strong.join(first, "indicator").where("email_id <> a").select("a", F.col("email_id").alias("b"))
    weak = shared(one.where(~is_strong(F.col("indicator")))).where("weak >= 2").select("a", "b")
    return stars.union(weak)


def near_digests(digests: DataFrame, most: int = FUZZY_BITS, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) of pairs of 64-bit digests that differ in at most `most` bits: exact, by pigeonhole blocks.

    With most + 1 blocks, two such digests agree in one block at least. A pair is told by the first block it agrees in.
    digests: id, digest (long).
    """
    blocks = blocks or most + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = digests.select("id", "digest", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("pos", "mask")).withColumn("key", F.col("digest").bitwiseAND(F.col("mask")))
    a, b = keyed.alias("a"), keyed.alias("b")
    xor = F.col("a.digest").bitwiseXOR(F.col("b.digest"))
    earlier = F.lit(False)
    for k, m in enumerate(masks):
        earlier = earlier | ((F.col("a.pos") > k) & (xor.bitwiseAND(F.lit(m)) == 0))
    on = (F.col("a.pos") == F.col("b.pos")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.bit_count(xor) <= most) & ~earlier
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.bit_count(xor).alias("distance"))


def by_digest(indicators: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cases whose indicators' SHA-256 is among the digests wanted; the indicators themselves aren't needed."""
    own = indicators.select("email_id", F.sha2("indicator", 256).alias("digest")).distinct()
    return own.join(wanted.select("digest").distinct(), "digest")


def campaigns(edges: DataFrame) -> DataFrame:
    """(email_id, campaign_id): components of linked cases, named by their oldest, smallest, member."""
    return components(edges).select(F.col("node").alias("email_id"), F.col("label").alias("campaign_id"))


def summaries(members: DataFrame, cases: DataFrame) -> DataFrame:
    """Each campaign's size, highest risk, categories and countries."""
    joined = members.join(cases, "email_id")
    return joined.groupBy("campaign_id").agg(F.count("*").alias("members"), F.max("risk").alias("max_risk"), F.array_sort(F.collect_set("country")).alias("countries"), F.countDistinct("category").alias("categories"))
