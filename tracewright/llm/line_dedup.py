"""Site-relative line dedup: lines that too large a share of a host's pages hold are boilerplate and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACES

#: A line goes if more than this share of its host's pages hold it, and so many pages do, be the host large or small.
RATIO, LEAST_PAGES = 0.05, 3
#: Boilerplate is broadcast up to so many lines; beyond, pages are joined to it by host, and hosts of more than so many
#: pages in several parts.
MOST_BROADCAST, PART = 200_000, 50_000


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, pages, bad array<long>): each host's number of pages, and the hashes of its boilerplate lines.

    A page counts once for each of its distinct lines, without white space at either end; blank lines don't count. Each
    row is a page. Counts are combined before the shuffle, so a host with most pages, or a line on most, is one row a
    task. A host's array holds at most 1/ratio times the distinct lines of its mean page.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _bare), lambda x: x != ""))
    one = pages.select(F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    total = one.groupBy("host").agg(F.count("*").alias("pages"))
    held = one.select("host", F.explode("lines").alias("line")).select("host", F.xxhash64("line").alias("h"))
    held = held.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    found = held.join(total, "host").where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.any_value("pages").alias("pages"), F.sort_array(F.collect_list("h")).alias("bad"))


def drop_boilerplate(
    pages: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    most_broadcast: int = MOST_BROADCAST,
    part: int = PART,
) -> DataFrame:
    """The rows of pages, with the lines that are boilerplate on their host taken out of the text.

    All rows and columns stay; a text of nothing but boilerplate becomes empty, a null text stays null. Null hosts are
    one host, "". Lines are told apart by 64-bit hashes. Adds _n_lines and _n_dropped, of lines that aren't blank.
    """
    bad = cut(boilerplate(pages, F.col(host_col), F.col(text_col), ratio, least_pages))
    n = bad.agg(F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()[0]
    rows = pages.select(F.struct("*").alias("_row"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    if n <= most_broadcast:
        joined = rows.join(F.broadcast(bad.drop("pages")), "host", "left")
    else:
        parts = F.ceil(F.col("pages") / part).cast("int")
        large = bad.where(parts > 1).select("host", parts.alias("parts"))  # a host for each `part` pages at most
        few = large.count() <= most_broadcast
        dealt = rows.join(F.broadcast(large) if few else large, "host", "left")
        own = F.pmod(F.xxhash64(F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}")), F.coalesce("parts", F.lit(1))).cast("int")
        salted = bad.select("host", "bad", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        joined = dealt.withColumn("salt", own).drop("parts").join(salted, ["host", "salt"], "left").drop("salt")
    split = joined.select("_row", F.split(F.col(f"_row.{text_col}"), "\n").alias("lines"), F.coalesce("bad", F.array().cast("array<bigint>")).alias("bad"))
    solid = lambda xs: F.size(F.filter(xs, lambda x: _bare(x) != ""))
    kept = split.withColumn("left", F.filter("lines", lambda x: (_bare(x) == "") | ~F.array_contains(F.col("bad"), F.xxhash64(_bare(x)))))
    counted = kept.withColumns({"n": F.when(F.col("lines").isNull(), 0).otherwise(solid("lines")), "m": F.when(F.col("lines").isNull(), 0).otherwise(solid("left"))})
    fields = [F.array_join("left", "\n").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in pages.columns]
    return counted.select(*fields, F.col("n").cast("long").alias("_n_lines"), (F.col("n") - F.col("m")).cast("long").alias("_n_dropped"))


def clean(pages: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of pages with boilerplate taken out of the text, and their columns only."""
    return drop_boilerplate(pages, host_col, text_col, id_col, **limits).select(*pages.columns)
