"""Queries of the URL functions, with pages as the carrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..session import table

ANCHOR = r'<a href="([^"]*)">'


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, pos, href) of each page's anchors, made absolute; the first of equal ones, 60 a page at most."""
    raw = pages(spark, sf).select("page_id", U.host(F.col("url")).alias("own"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "href"))
    full = raw.withColumn("href", F.when(F.col("href").startswith("/"), F.concat(F.lit("http://"), "own", "href")).otherwise(F.col("href")))
    first = Window.partitionBy("page_id", "href").orderBy("pos")
    kept = full.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    cap = Window.partitionBy("page_id").orderBy("pos")
    return kept.withColumn("k", F.row_number().over(cap)).where("k <= 60").drop("k", "own")


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("url")
    of = pages(spark, sf).select("page_id", "url", U.host(c).alias("host"), U.registrable(U.host(c)).alias("domain"), U.flags(c).alias("flags"), U.keywords(c).alias("words"))
    shortener = F.col("domain").isin(*U.SHORTENERS)
    return of.withColumn("risk", U.risk(F.col("flags"), F.col("words"), F.lit(False), F.contains(U.authority(c), F.lit("@")), shortener))


_SUFFIX = ", ".join(f"'{s}'" for s in sorted(U.SUFFIXES))
_HOST = "lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_LABELS = "string_split(host, '.')"
_DOMAIN = f"CASE WHEN len({_LABELS}) >= 3 AND array_to_string({_LABELS}[-2:], '.') IN ({_SUFFIX}) THEN array_to_string({_LABELS}[-3:], '.') WHEN len({_LABELS}) >= 2 THEN array_to_string({_LABELS}[-2:], '.') ELSE host END"
_NORM = f"split_part(url, '://', 1) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END"
_WORDS = ", ".join(f"CASE WHEN contains(host || ' ' || lower(path), '{k}') THEN '{k}' END" for k in U.KEYWORDS)
_BASE = f"WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, {_NORM} AS norm FROM pages), a AS (SELECT *, {_DOMAIN} AS domain, list_filter([{_WORDS}], lambda x: x IS NOT NULL) AS words FROM u)"
_BASE += """, f AS (SELECT *, list_filter([
    CASE WHEN (length(host) - length(replace(host, '.', ''))) - (length(domain) - length(replace(domain, '.', ''))) > 3 THEN 'excessive_subdomains' END,
    CASE WHEN length(norm) > 120 THEN 'long_url' END,
    CASE WHEN regexp_matches(regexp_replace(norm, '^[^:]*://', ''), '(?i)://|https?(:|%3a)') THEN 'double_scheme' END,
    CASE WHEN len(regexp_extract_all(path || query, '%[0-9A-Fa-f]{2}')) >= 3 THEN 'hex_escapes' END,
    CASE WHEN list_contains(['TLDS'], split_part(host, '.', -1)) THEN 'suspicious_tld' END,
    CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]{1,10})$', 1)) IN ('EXTS') THEN 'file_extension_executable' END], lambda x: x IS NOT NULL) AS flags FROM a)""".replace("['TLDS']", str(U.SUSPICIOUS_TLDS)).replace("('EXTS')", str(tuple(U.RISKY_EXTENSIONS)))
_RISK = "CASE WHEN list_contains(flags, 'file_extension_executable') THEN 'critical' WHEN list_contains(flags, 'suspicious_tld') OR len(flags) >= 2 THEN 'medium' WHEN len(flags) >= 1 OR len(words) >= 2 THEN 'low' ELSE 'info' END"
_LINKS = f"""WITH raw AS (SELECT page_id, {_HOST} AS own, regexp_extract_all(html, '{ANCHOR}', 1) AS hrefs FROM pages), e AS (SELECT page_id, own, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href FROM raw),
f AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN 'http://' || own || href ELSE href END AS href FROM e), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1),
links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 60)"""

QUERIES = {
    "url_norm": lambda s, d: pages(s, d).select("page_id", U.normalize_url(F.col("url")).alias("normalized")),
    "registrable": lambda s, d: pages(s, d).select("page_id", U.registrable(U.host(F.col("url"))).alias("domain")),
    "host_suffix": lambda s, d: pages(s, d).select("page_id", U.host_within(U.host(F.col("url")), "example.com").alias("inside")),
    "url_clean": lambda s, d: pages(s, d).select("page_id", U.clean_url(F.concat("url", F.lit(").,"))).alias("clean")),
    "url_extract": links,
    "url_numeric_ip": lambda s, d: pages(s, d).agg(F.count_if(U.numeric_form(U.host(F.col("url")))).alias("numeric"), F.count_if(U.numeric_form(F.col("page_id").cast("string"))).alias("numbers")),
    "url_redirect": lambda s, d: pages(s, d).select("page_id", U.redirects(F.concat(F.lit("http://a.example.com/?url=http://x."), U.registrable(U.host(F.col("url"))))).alias("leaves")),
    "url_analyse": lambda s, d: analysed(s, d).select("page_id", "domain", F.array_join("flags", ",").alias("flags"), F.array_join("words", ",").alias("words"), "risk"),
    "url_agg": lambda s, d: analysed(s, d).groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.count_if(F.size("flags") > 0).alias("flagged"), F.max(F.size("words")).alias("most_words")),
    "url_features": lambda s, d: pages(s, d).select("page_id", F.length("url").alias("length"), F.length(U.host(F.col("url"))).alias("host_length"), F.length(U.path(F.col("url"))).alias("path_length"), F.regexp_count("url", F.lit("[0-9]")).alias("digits"), F.regexp_count(U.host(F.col("url")), F.lit("[.]")).alias("dots"), (U.scheme(F.col("url")) == "https").cast("int").alias("https")),
    "dom_collect": lambda s, d: links(s, d).select("page_id", "pos", U.registrable(U.host(F.col("href"))).alias("domain")).groupBy("page_id", "domain").agg(F.min("pos").alias("pos")).withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "domain"))).where("k <= 6").select("page_id", "domain", "k"),
    "anchor_mismatch": lambda s, d: links(s, d).select("page_id", "pos", (U.registrable(U.host(F.col("href"))) != "example.com").alias("mismatch")),
    "html_to_text": lambda s, d: pages(s, d).select("page_id", T.collapse(F.regexp_replace(F.regexp_replace("html", r"(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->", " "), r"<[^>]*>", " ")).alias("text")),
}

ORACLE_SQL = {
    "url_norm": f"SELECT page_id, {_NORM} AS normalized FROM pages",
    "registrable": f"SELECT page_id, {_DOMAIN} AS domain FROM (SELECT page_id, {_HOST} AS host FROM pages)",
    "host_suffix": f"SELECT page_id, {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS inside FROM pages",
    "url_clean": "SELECT page_id, url AS clean FROM pages",
    "url_extract": _LINKS + " SELECT * FROM links",
    "url_numeric_ip": "SELECT 0::BIGINT AS numeric, count(*) FILTER (page_id > 255) AS numbers FROM pages",
    "url_redirect": f"SELECT page_id, {_DOMAIN} <> 'example.com' AS leaves FROM (SELECT page_id, {_HOST} AS host FROM pages)",
    "url_analyse": _BASE + f" SELECT page_id, domain, array_to_string(flags, ',') AS flags, array_to_string(words, ',') AS words, {_RISK} AS risk FROM f",
    "url_agg": _BASE + " SELECT domain, count(*) AS n, count(DISTINCT host) AS hosts, count(*) FILTER (len(flags) > 0) AS flagged, CAST(max(len(words)) AS INTEGER) AS most_words FROM f GROUP BY domain",
    "url_features": f"SELECT page_id, CAST(length(url) AS INTEGER) AS length, CAST(length({_HOST}) AS INTEGER) AS host_length, CAST(length({_PATH}) AS INTEGER) AS path_length, CAST(len(regexp_extract_all(url, '[0-9]')) AS INTEGER) AS digits, CAST(len(regexp_extract_all({_HOST}, '[.]')) AS INTEGER) AS dots, CAST(starts_with(url, 'https://') AS INTEGER) AS https FROM pages",
    "dom_collect": _LINKS + f", h AS (SELECT page_id, pos, lower(regexp_extract(href, '^[^:/?#]+://([^/?#:]*)', 1)) AS host FROM links), m AS (SELECT page_id, {_DOMAIN} AS domain, min(pos) AS pos FROM h GROUP BY ALL) SELECT page_id, domain, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, domain) AS INTEGER) AS k FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos, domain) <= 6",
    "anchor_mismatch": _LINKS + f", h AS (SELECT page_id, pos, lower(regexp_extract(href, '^[^:/?#]+://([^/?#:]*)', 1)) AS host FROM links) SELECT page_id, pos, {_DOMAIN} <> 'example.com' AS mismatch FROM h",
    "html_to_text": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages",
}
