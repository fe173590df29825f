"""Enrichment by injected tables: places, networks, domains, sender policies, file reputation. Nothing is looked up online."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from ..functions.text import text_or_empty
from ..session import cut

#: Formats in which registries give dates, tried in order.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd"]
#: Limits of SPF evaluation.
MOST_LOOKUPS = 10


def registry_date(c: Column) -> Column:
    """A registry's date by the first format that fits; null where none does."""
    bare = F.regexp_replace(F.trim(text_or_empty(c)), r"(?:\.\d+)?(?:Z|\s*UTC|\s*\(.*\)|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS])


def whois_field(c: Column, names: list[str]) -> Column:
    """The first of a reply's 'Name: value' lines of any of these names."""
    return F.trim(F.regexp_extract(text_or_empty(c), r"(?im)^\s*(?:" + "|".join(names) + r")\s*:\s*(.+)$", 1))


def age_band(days: Column) -> Column:
    """How suspicious a domain's age is: under 30, 90 or 365 days, or older; unknown for null."""
    return F.when(days.isNull(), "unknown").when(days < 30, "high").when(days < 90, "medium").when(days < 365, "low").otherwise("info")


def asn_parts(c: Column) -> Column:
    """struct<asn, org> of 'AS123 Name'."""
    t = text_or_empty(c)
    return F.struct(F.regexp_extract(t, r"^(AS\d+)", 1).alias("asn"), F.trim(F.regexp_replace(t, r"^AS\d+\s*", "")).alias("org"))


def locate(addresses: DataFrame, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds country and source by the first table that knows an address; private ones aren't looked up.

    addresses: ip. tables: (name, DataFrame of ip and country), in order of preference. What none knows is unavailable.
    """
    out = addresses.withColumn("_private", F.coalesce(net.is_private(net.ip_number(F.col("ip"))), F.lit(False)))
    for k, (_, known) in enumerate(tables):
        out = out.join(known.select("ip", F.col("country").alias(f"_c{k}")), "ip", "left")
    found = F.coalesce(*[F.when(F.col(f"_c{k}").isNotNull(), F.struct(F.col(f"_c{k}").alias("country"), F.lit(name).alias("source"))) for k, (name, _) in enumerate(tables)], F.struct(F.lit("").alias("country"), F.lit("unavailable").alias("source")))
    place = F.when(F.col("_private"), F.struct(F.lit("").alias("country"), F.lit("private").alias("source"))).otherwise(found)
    return out.withColumn("_p", place).select(*addresses.columns, F.col("_p.country").alias("country"), F.col("_p.source").alias("source"))


def in_networks(addresses: DataFrame, networks: DataFrame, bits: int = 8) -> DataFrame:
    """The most specific network of each address, joined by the addresses' first bits instead of all against all.

    addresses: ip, n. networks: cidr, lo, hi, of any size; those wider than a bucket stand in each bucket they cover.
    """
    width = 1 << (32 - bits)
    buckets = networks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    keyed = addresses.withColumn("_b", F.floor(F.col("n") / width))
    hit = keyed.join(buckets, "_b").where(F.col("n").between(F.col("lo"), F.col("hi")))
    return hit.groupBy(*[F.col(c) for c in addresses.columns]).agg(F.min_by("cidr", F.struct(F.col("hi") - F.col("lo"), "cidr")).alias("cidr"))


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def with_domain(rows: DataFrame, domains: DataFrame, exact: str = "host", wider: str = "domain") -> DataFrame:
    """Joins a domain table by the registrable domain, or else by the host itself."""
    a = domains.select(F.col("domain").alias(wider), F.col("age_days").alias("_a"))
    b = domains.select(F.col("domain").alias(exact), F.col("age_days").alias("_b"))
    return rows.join(a, wider, "left").join(b, exact, "left").withColumn("age_days", F.coalesce("_a", "_b")).drop("_a", "_b")


def reputation(domains: DataFrame, lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds tags: the names of the lists that hold a domain, in the lists' order."""
    out = domains
    for name, known in lists:
        out = out.join(known.select("domain", F.lit(name).alias(f"_{name}")).distinct(), "domain", "left")
    return out.withColumn("tags", F.array_compact(F.array(*[F.col(f"_{name}") for name, _ in lists]))).drop(*[f"_{name}" for name, _ in lists])


def verdict_of_stats(malicious: Column, suspicious: Column) -> Column:
    """How bad scanners find a file."""
    return F.when(malicious >= 3, "critical").when(malicious >= 1, "high").when(suspicious >= 1, "medium").otherwise("info")


def spf_networks(terms: DataFrame, most: int = MOST_LOOKUPS) -> DataFrame:
    """(domain, qualifier, cidr, steps): the networks of each domain's policy, includes and redirects followed.

    terms: domain, pos, qualifier, mechanism, value. Each step is a join of all domains at once; at most `most` are taken,
    so policies that include each other end. What an include allows passes with the include's own qualifier.
    """
    first = terms.select("domain").distinct().select("domain", F.col("domain").alias("at"), F.lit(None).cast("string").alias("as_"), F.lit(0).alias("steps"))
    found, edge = [], first
    for k in range(most):
        here = edge.join(terms.withColumnRenamed("domain", "at"), "at")
        found.append(here.where(F.col("mechanism").isin("ip4", "all")).select("domain", F.coalesce("as_", "qualifier").alias("qualifier"), F.when(F.col("mechanism") == "all", "0.0.0.0/0").otherwise(F.col("value")).alias("cidr"), "steps", F.col("mechanism").alias("_m"), F.col("as_").alias("_via")))
        nxt = here.where(F.col("mechanism").isin("include", "redirect")).select("domain", F.col("value").alias("at"), F.when(F.col("mechanism") == "include", F.coalesce("as_", "qualifier")).otherwise(F.col("as_")).alias("as_"), F.lit(k + 1).alias("steps"))
        edge = cut(nxt.distinct())
        if edge.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    # An included policy's own 'all' says nothing about the including domain.
    return every.where((F.col("_m") != "all") | F.col("_via").isNull()).select("domain", "qualifier", "cidr", "steps").distinct()


def spf_result(qualifier: Column) -> Column:
    return F.when(qualifier == "+", "pass").when(qualifier == "-", "fail").when(qualifier == "~", "softfail").when(qualifier == "?", "neutral").otherwise("none")


def fuse_spf(live: Column, recorded: Column) -> Column:
    """What is measured and says something, then what is recorded, then what is measured."""
    return F.when(live.isin("pass", "fail", "softfail", "neutral"), live).when(recorded.isNotNull(), recorded).when(live == "none", live).when(live.isNotNull(), "unverifiable").otherwise("none")


def dmarc_policy(domains: DataFrame, records: DataFrame) -> DataFrame:
    """Adds policy by the domain's own record, or else by its organisation's. domains: domain, org."""
    a = records.select("domain", F.col("policy").alias("_a"))
    b = records.select(F.col("domain").alias("org"), F.col("policy").alias("_b"))
    return domains.join(a, "domain", "left").join(b, "org", "left").withColumn("policy", F.coalesce("_a", "_b", F.lit("none"))).drop("_a", "_b")


def canonical(columns: list[str]) -> Column:
    """A row as JSON with sorted keys and no spaces; nulls are left out, letters stay as they are."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def sections(case: DataFrame, parts: dict[str, list[str]], key: str) -> DataFrame:
    """(key, section, field, value): a case as rows of a report, in the order of the parts."""
    rows = [F.struct(F.lit(k).alias("pos"), F.lit(section).alias("section"), F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for k, (section, c) in enumerate((s, c) for s, cs in parts.items() for c in cs)]
    return case.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.pos", "r.section", "r.field", "r.value")


def timeline(parts: list[tuple[DataFrame, str]], key: str, at: str) -> DataFrame:
    """(key, place, at, what) of events of several kinds, each case's in order."""
    every = reduce(DataFrame.unionByName, [df.select(key, F.col(at).alias("at"), F.lit(what).alias("what")) for df, what in parts]).where("at IS NOT NULL")
    return every.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "what")))


def relabel(rows: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Free-form labels' probabilities summed by the classes they stand for, and made to sum to one again. labels: raw, label."""
    summed = rows.join(F.broadcast(labels), "raw").groupBy(*keep, "label").agg(F.sum("p").alias("p"))
    total = F.sum("p").over(Window.partitionBy(*keep))
    return summed.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(0.0))


def dissolve(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Campaign members without purged cases; a campaign of fewer than two is none."""
    left = members.join(gone.select("email_id").distinct(), "email_id", "left_anti")
    return left.withColumn("_n", F.count("*").over(Window.partitionBy("campaign_id"))).where("_n >= 2").drop("_n")
