"""Queries of scores and rules, with line items as carriers of numbers, and of correlation and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import correlate as C
from ..operators import graphs as G
from ..session import table

_SPF = ["pass", "fail", "softfail", "none", "neutral", "unverifiable"]
_DKIM = ["pass", "fail", "none", "unverifiable", "permerror"]
_DMARC = ["pass", "fail", "none"]


def _pick(names: list[str], n):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def _sql_pick(names: list[str], n: str) -> str:
    return f"[{', '.join(repr(x) for x in names)}][{n} % {len(names)} + 1]"


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as messages with the signals that scores take."""
    li = table(spark, sf, "lineitem")
    k, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        _pick(_SPF, k + p).alias("spf"),
        _pick(_DKIM, s).alias("dkim"),
        _pick(_DMARC, p).alias("dmarc"),
        (F.col("l_returnflag") == "R").alias("reject"),
        (k % 3).alias("misaligned"),
        (p % 7 == 0).alias("protected"),
        (F.col("l_quantity") / 50).alias("nlp"),
        (F.col("l_discount") * 8).alias("bec"),
        (F.col("l_tax") * 5).alias("url"),
        (s % 13 == 0).alias("lookalike"),
        (p % 200).alias("age"),
        (s % 17 == 0).alias("disposable"),
        F.col("l_discount").alias("model"),
        (F.col("l_tax") * 9).alias("att"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.07)).alias("packed"),
        (F.col("l_quantity") * 1.5).alias("infra"),
        (F.col("l_discount") * 500).alias("routing"),
        (p % 90).alias("intel"),
        _pick(["Legitimate", "Suspicious", "Phishing", "Fraud-Related", "Impersonated"], p + k).alias("ml"),
    )


_SIGNALS = f"""WITH signals AS (
    SELECT l_orderkey, l_linenumber, {_sql_pick(_SPF, "(l_linenumber + l_partkey)")} AS spf, {_sql_pick(_DKIM, "l_suppkey")} AS dkim, {_sql_pick(_DMARC, "l_partkey")} AS dmarc,
           l_returnflag = 'R' AS reject, l_linenumber % 3 AS misaligned, l_partkey % 7 = 0 AS protected, l_quantity / 50 AS nlp, l_discount * 8 AS bec, l_tax * 5 AS url,
           l_suppkey % 13 = 0 AS lookalike, l_partkey % 200 AS age, l_suppkey % 17 = 0 AS disposable, l_discount AS model, l_tax * 9 AS att, l_linestatus = 'F' AND l_tax > 0.07 AS packed,
           l_quantity * 1.5 AS infra, l_discount * 500 AS routing, l_partkey % 90 AS intel, {_sql_pick(["Legitimate", "Suspicious", "Phishing", "Fraud-Related", "Impersonated"], "(l_partkey + l_linenumber)")} AS ml
    FROM lineitem
), pillars AS (
    SELECT *,
        greatest(0, least(100, CASE spf WHEN 'fail' THEN 45 WHEN 'softfail' THEN 25 WHEN 'none' THEN 15 WHEN 'neutral' THEN 15 WHEN 'unverifiable' THEN 10 ELSE 0 END
            + CASE dkim WHEN 'fail' THEN 35 WHEN 'none' THEN 10 WHEN 'unverifiable' THEN 5 WHEN 'permerror' THEN 5 ELSE 0 END
            + CASE WHEN dmarc = 'fail' AND reject THEN 60 WHEN dmarc = 'fail' THEN 40 WHEN dmarc = 'none' THEN 10 ELSE 0 END
            + 15 * misaligned + CASE WHEN protected AND (spf IN ('fail', 'softfail') OR dkim = 'fail' OR dmarc = 'fail') THEN 20 ELSE 0 END))::DOUBLE AS auth,
        greatest(0.0, least(100.0, 100 * (0.7::DOUBLE * nlp + 0.3::DOUBLE * bec))) AS txt,
        greatest(100 * url, CASE WHEN lookalike THEN 85.0 ELSE 0 END, CASE WHEN age < 30 THEN 75.0 WHEN age < 90 THEN 50.0 ELSE 0 END, CASE WHEN disposable THEN 60.0 ELSE 0 END)::DOUBLE AS floor_,
        greatest(0.0, least(100.0, greatest(100 * att, CASE WHEN packed THEN 90.0 ELSE 0 END)))::DOUBLE AS entropy,
        greatest(infra, routing, intel) AS top
    FROM signals
), scored AS (
    SELECT *, greatest(0.0, least(100.0, floor_ + (100 - floor_) * 0.5::DOUBLE * model))::DOUBLE AS link, greatest(0.0, least(100.0, top + 0.2::DOUBLE * (infra + routing + intel - top) / 2))::DOUBLE AS network FROM pillars
), risked AS (
    SELECT *, CAST(round_even(round(auth * 0.2::DOUBLE + txt * 0.35::DOUBLE + link * 0.25::DOUBLE + network * 0.1::DOUBLE + entropy * 0.1::DOUBLE, 6), 0) AS INTEGER) AS risk FROM scored
), ruled AS (
    SELECT *, CASE WHEN lookalike AND risk >= 50 THEN 'Phishing' WHEN bec >= 0.7 THEN 'Fraud-Related' WHEN dmarc = 'fail' AND protected THEN 'Impersonated' WHEN risk >= 25 OR bec >= 0.5 THEN 'Suspicious' ELSE 'Legitimate' END AS rule FROM risked
)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    of = signals(spark, sf)
    of = of.withColumns(
        {
            "auth": S.pillar_auth(c("spf"), c("dkim"), c("dmarc"), c("reject"), c("misaligned"), c("protected")),
            "txt": S.pillar_text(c("nlp"), c("bec")),
            "link": S.pillar_url(c("url"), c("lookalike"), c("age"), c("disposable"), c("model")),
            "network": S.pillar_network([c("infra"), c("routing"), c("intel").cast("double")]),
            "entropy": S.pillar_entropy(c("att"), c("packed")),
        }
    )
    return of.withColumn("risk", S.risk({"auth": c("auth"), "text": c("txt"), "url": c("link"), "network": c("network"), "entropy": c("entropy")}))


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rules = [("Phishing", c("lookalike") & (c("risk") >= 50)), ("Fraud-Related", c("bec") >= 0.7), ("Impersonated", (c("dmarc") == "fail") & c("protected")), ("Suspicious", (c("risk") >= 25) | (c("bec") >= 0.5))]
    return scored(spark, sf).withColumn("rule", S.ladder(rules, "Legitimate"))


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as messages: suppliers are strong indicators, part sizes and priorities weak ones."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(
        F.col("l_orderkey").alias("email_id"),
        F.explode(
            F.array(
                F.when(F.col("l_linenumber") == 1, F.concat(F.lit("sender:"), F.col("l_partkey"))),
                F.concat_ws("-", F.concat(F.lit("subject:"), F.col("p_size")), "p_brand", "l_suppkey"),
                F.concat_ws("-", F.concat(F.lit("mailer:"), F.col("l_suppkey")), F.col("l_quantity").cast("int")),
            )
        ).alias("indicator"),
    )
    return rows.where("indicator IS NOT NULL").distinct()


_IND = """WITH RECURSIVE j AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey), ind AS (
    SELECT DISTINCT l_orderkey AS email_id, unnest([CASE WHEN l_linenumber = 1 THEN 'sender:' || l_partkey END, 'subject:' || p_size || '-' || p_brand || '-' || l_suppkey, 'mailer:' || l_suppkey || '-' || CAST(l_quantity AS INTEGER)]) AS indicator FROM j
), own AS (SELECT * FROM ind WHERE indicator IS NOT NULL), pairs AS (
    SELECT a.email_id AS a, b.email_id AS b, count(*) FILTER (starts_with(a.indicator, 'sender:')) AS strong, count(*) FILTER (NOT starts_with(a.indicator, 'sender:')) AS weak
    FROM own a JOIN own b ON a.indicator = b.indicator AND a.email_id < b.email_id GROUP BY ALL
), related AS (SELECT * FROM pairs WHERE strong >= 1 OR weak >= 2)"""
_COMPONENTS = """, sym AS (SELECT a AS x, b AS y FROM related WHERE strong >= 1 UNION SELECT b, a FROM related WHERE strong >= 1),
reach(x, y) AS (SELECT x, x FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)"""


def strong_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    only = indicators(spark, sf).where(C.is_strong(F.col("indicator")))
    return C.campaigns(C.links(only))


def digests(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 16), 16, -10).cast("bigint").alias("digest"))


def supply_nodes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("graph", F.col("l_orderkey"))
    return G.nodes([(li, "domain", F.col("l_suppkey"), F.col("l_quantity")), (li, "url", F.col("l_partkey"), F.col("l_linenumber")), (li, "ip", F.col("l_returnflag"), F.lit(0))])


def supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("graph", F.col("l_orderkey"))
    a, b, c = G.node_id("domain", F.col("l_suppkey")), G.node_id("url", F.col("l_partkey")), G.node_id("ip", F.col("l_returnflag"))
    return G.edges([(li, b, a, "links_to"), (li, a, c, "resolves_to")])


_NODES = """WITH n AS (SELECT l_orderkey AS graph, 'domain:' || l_suppkey AS id, 'domain' AS kind, CAST(l_quantity AS INTEGER) AS risk FROM lineitem
    UNION ALL SELECT l_orderkey, 'url:' || l_partkey, 'url', l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, 'ip:' || lower(l_returnflag), 'ip', 0 FROM lineitem)"""
_EDGES = "SELECT DISTINCT l_orderkey AS graph, 'url:' || l_partkey AS source, 'domain:' || l_suppkey AS target, 'links_to' AS relation FROM lineitem UNION SELECT DISTINCT l_orderkey, 'domain:' || l_suppkey, 'ip:' || lower(l_returnflag), 'resolves_to' FROM lineitem"


def _scored(name):
    return lambda s, d: scored(s, d).select("l_orderkey", "l_linenumber", F.round(name, 4).alias(name))


def _guarded(s, d):
    return ruled(s, d).select("l_orderkey", "l_linenumber", S.guarded(F.col("rule"), F.col("risk"), F.col("bec")).alias("g")).select("l_orderkey", "l_linenumber", "g.category", "g.risk")


QUERIES = {
    "pillar_auth": _scored("auth"),
    "pillar_text": _scored("txt"),
    "pillar_network": _scored("network"),
    "pillar_entropy": _scored("entropy"),
    "risk": _scored("risk"),
    "severity_band": lambda s, d: scored(s, d).groupBy(S.severity_band(F.col("risk"), F.col("misaligned") > 0).alias("band")).agg(F.count("*").alias("n")),
    "fuse": lambda s, d: ruled(s, d).select("l_orderkey", "l_linenumber", F.round(S.fuse_confidence(F.col("rule"), F.col("ml"), F.col("model"), F.col("risk")), 6).alias("confidence")),
    "guards": _guarded,
    "infra": lambda s, d: signals(s, d).select("l_orderkey", "l_linenumber", F.array(F.when(F.col("disposable"), 0.6), F.when(F.col("lookalike"), 0.8), F.when(F.col("protected"), 0.4)).alias("x")).select("l_orderkey", "l_linenumber", F.array_compact("x").alias("x")).select("l_orderkey", "l_linenumber", F.round(F.coalesce(F.least(F.lit(1.0), F.array_max("x") + 0.1 * (F.size("x") - 1)), F.lit(0.0)), 6).alias("score")),
    "agg_findings": lambda s, d: signals(s, d).groupBy("l_orderkey", "spf").agg(F.min("l_linenumber").alias("first")).orderBy("l_orderkey", "first"),
    "indicators": indicators,
    "j_indicator": lambda s, d: C.shared(indicators(s, d)),
    "j_related": lambda s, d: C.related(indicators(s, d)).select("a", "b"),
    "j_prefix": lambda s, d: indicators(s, d).where(F.col("indicator").startswith("subject:1")).groupBy("indicator").agg(F.count("*").alias("n")),
    "j_digest": lambda s, d: C.by_digest(indicators(s, d), indicators(s, d).where("email_id < 100").select(F.sha2("indicator", 256).alias("digest"))).groupBy("email_id").agg(F.count("*").alias("n")),
    "j_fuzzy": lambda s, d: C.near_digests(digests(s, d)).select("a", "b", F.col("distance").cast("int").alias("distance")),
    "campaign_assign": strong_campaigns,
    "campaign_summary": lambda s, d: strong_campaigns(s, d).groupBy("campaign_id").agg(F.count("*").alias("members")),
    "graph_nodes": supply_nodes,
    "graph_build": supply_edges,
    "graph_merge": lambda s, d: G.merged(supply_nodes(s, d)),
    "agg_shared_by": lambda s, d: G.shared(supply_nodes(s, d)),
    "graph_pivot": lambda s, d: G.reach(supply_edges(s, d), F.col("id") == "domain:1", 2),
}


def _p(name: str) -> str:
    return _SIGNALS + f" SELECT l_orderkey, l_linenumber, round({name}, 4) AS {name} FROM ruled"


ORACLE_SQL = {
    "pillar_auth": _p("auth"),
    "pillar_text": _p("txt"),
    "pillar_network": _p("network"),
    "pillar_entropy": _p("entropy"),
    "risk": _SIGNALS + " SELECT l_orderkey, l_linenumber, risk FROM ruled",
    "severity_band": _SIGNALS + " SELECT CASE WHEN risk <= 0 AND misaligned = 0 THEN 'info' WHEN risk < 25 THEN 'low' WHEN risk < 50 THEN 'medium' WHEN risk < 75 THEN 'high' ELSE 'critical' END AS band, count(*) AS n FROM ruled GROUP BY 1",
    "fuse": _SIGNALS + " SELECT l_orderkey, l_linenumber, round(CASE WHEN rule = ml THEN least(0.98::DOUBLE, 0.75::DOUBLE + 0.25::DOUBLE * model) WHEN (rule <> 'Legitimate' AND risk >= 50) OR (rule = 'Legitimate' AND risk < 25) THEN 0.7 ELSE 0.6 END::DOUBLE, 6) AS confidence FROM ruled",
    "guards": _SIGNALS + """, g AS (SELECT *, CASE WHEN rule = 'Legitimate' AND risk >= 40 THEN 'Suspicious' ELSE rule END AS category FROM ruled)
        SELECT l_orderkey, l_linenumber, category, greatest(risk, CASE category WHEN 'Phishing' THEN 60 WHEN 'Fraud-Related' THEN 60 WHEN 'Impersonated' THEN 45 WHEN 'Suspicious' THEN 25 ELSE 0 END, CASE WHEN bec >= 0.5 AND category <> 'Legitimate' THEN 50 ELSE 0 END) AS risk FROM g""",
    "infra": _SIGNALS + ", x AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN disposable THEN 0.6::DOUBLE END, CASE WHEN lookalike THEN 0.8::DOUBLE END, CASE WHEN protected THEN 0.4::DOUBLE END], lambda v: v IS NOT NULL) AS x FROM signals) SELECT l_orderkey, l_linenumber, round(coalesce(least(1.0::DOUBLE, list_max(x) + 0.1::DOUBLE * (len(x) - 1)), 0.0), 6) AS score FROM x",
    "agg_findings": _SIGNALS + " SELECT l_orderkey, spf, min(l_linenumber) AS first FROM signals GROUP BY ALL",
    "indicators": _IND + " SELECT * FROM own",
    "j_indicator": _IND + " SELECT * FROM pairs",
    "j_related": _IND + " SELECT a, b FROM related",
    "j_prefix": _IND + " SELECT indicator, count(*) AS n FROM own WHERE starts_with(indicator, 'subject:1') GROUP BY 1",
    "j_digest": _IND + " SELECT email_id, count(DISTINCT indicator) AS n FROM own WHERE sha256(indicator) IN (SELECT sha256(indicator) FROM own WHERE email_id < 100) GROUP BY 1",
    "j_fuzzy": "WITH d AS (SELECT doc_id AS id, CAST('0x' || substring(md5(text), 1, 16) AS UBIGINT) AS digest FROM documents) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.digest, b.digest)) AS INTEGER) AS distance FROM d a JOIN d b ON a.id < b.id AND bit_count(xor(a.digest, b.digest)) <= 12",
    "campaign_assign": _IND + _COMPONENTS + " SELECT x AS email_id, min(y) AS campaign_id FROM reach GROUP BY x",
    "campaign_summary": _IND + _COMPONENTS + " SELECT campaign_id, count(*) AS members FROM (SELECT x, min(y) AS campaign_id FROM reach GROUP BY x) GROUP BY 1",
    "graph_nodes": _NODES + " SELECT * FROM n",
    "graph_build": _EDGES,
    "graph_merge": _NODES + " SELECT id, kind, max(risk) AS risk, count(DISTINCT graph) AS graphs FROM n GROUP BY id, kind",
    "agg_shared_by": _NODES + " SELECT id, kind, max(risk) AS risk, count(DISTINCT graph) AS graphs FROM n GROUP BY id, kind HAVING count(DISTINCT graph) >= 2",
    "graph_pivot": f"WITH e AS ({_EDGES}), s AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), h AS (SELECT 'domain:1' AS id, 0 AS hops WHERE EXISTS (SELECT 1 FROM s WHERE a = 'domain:1') UNION ALL SELECT b, 1 FROM s WHERE a = 'domain:1' UNION ALL SELECT t.b, 2 FROM s JOIN s t ON s.b = t.a WHERE s.a = 'domain:1') SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY id",
}
