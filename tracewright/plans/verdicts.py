"""Queries of the verdicts: the whole ladder of rules, sources of attacks, parts of the network pillar.

The test tables hold no such signals, so numbers of line items carry them: CARRIERS says in SQL that both engines read how
each is made up. What follows from the signals is written twice, as columns and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net as N
from ..functions import scores as S
from ..session import table

_SHARE = "CAST(({}) % 11 AS DOUBLE) / 10"
_MODEL = "CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'Phishing' WHEN 1 THEN 'Fraud-Related' WHEN 2 THEN 'Impersonated' WHEN 3 THEN 'Suspicious' ELSE 'Legitimate' END"
CARRIERS: dict[str, str] = {
    **{name: f"CASE WHEN (l_partkey + 3 * l_suppkey) % {23 + 6 * i} < 3 THEN {_SHARE.format(f'l_partkey + {i} * l_linenumber')} ELSE 0.0 END" for i, name in enumerate(S.CONFIDENCES)},
    **{name: f"CASE WHEN (l_suppkey + {i} * l_linenumber) % {11 + i} = 0 THEN l_partkey % 4 ELSE 0 END" for i, name in enumerate(S.COUNTS)},
    "risk": "(l_partkey * 7 + l_suppkey) % 60",
    **{name: f"(l_partkey + {i} * l_suppkey) % {13 + 2 * i} = 0" for i, name in enumerate(S.TRUTHS)},
    "model": _MODEL,
    "p": _SHARE.format("l_suppkey + l_partkey"),
    "lookalike": "l_suppkey % 13 = 0",
    "auth_missing": "l_partkey % 17 = 0",
    "age_days": "CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 700 END",
    "spf_pass": "l_linenumber % 2 = 0",
    "dkim_pass": "l_suppkey % 3 > 0",
    "aligned": "l_partkey % 3 > 0",
    "freemail": "l_suppkey % 4 = 0",
    "tor": "l_partkey % 31 = 0",
    "disposable": "l_suppkey % 17 = 0",
    "vpn": "l_partkey % 19 = 0",
    "hosting": "l_suppkey % 7 = 0",
    "resolves": "CASE WHEN l_partkey % 3 > 0 THEN l_suppkey % 5 > 0 END",
    "has_mx": "CASE WHEN l_partkey % 3 > 0 THEN l_suppkey % 6 > 0 END",
    "n_hops": "l_linenumber % 4",
    "any_public": "l_partkey % 6 > 0",
    "origin_confidence": f"CASE WHEN l_suppkey % 9 > 0 THEN {_SHARE.format('l_partkey')} END",
    **{name: f"(l_partkey + {i + 1} * l_linenumber) % {i + 3} = 0" for i, name in enumerate(S.ROUTING)},
    "listed_ip": "l_partkey % 41 = 0",
    "listed_infra": "l_partkey % 23 = 0",
    "worst_related": "CASE WHEN l_suppkey % 8 = 0 THEN l_partkey % 101 END",
}
_KEYS = ["l_orderkey", "l_linenumber"]


def carried(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the signals that they carry."""
    return table(spark, sf, "lineitem").select(*_KEYS, *[F.expr(x).alias(name) for name, x in CARRIERS.items()])


def _signals() -> dict:
    return {k: F.col(k) for k in CARRIERS}


def judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = carried(spark, sf).withColumn("v", S.verdict(S.threat_rules(_signals())))
    return rows.withColumns({"category": F.col("v.category"), "reasons": F.array_join("v.reasons", ",")})


def _attribution(spark: SparkSession, sf: str) -> DataFrame:
    established = F.coalesce(F.col("age_days") >= 365, F.lit(False)) | F.col("protected")
    rows = judged(spark, sf).withColumn("a", S.attribution(F.col("category"), F.col("p"), _signals() | {"established": established}))
    return rows.select(*_KEYS, "a.source", "a.confidence")


def _routing(spark: SparkSession, sf: str) -> DataFrame:
    anomalies = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name in S.ROUTING]))
    return carried(spark, sf).select(*_KEYS, S.routing_part(anomalies, F.col("n_hops"), F.col("any_public"), F.col("origin_confidence")).alias("routing"))


_V4 = "concat(CAST(1 + l_suppkey % 223 AS STRING), '.', CAST(l_partkey % 256 AS STRING), '.0.1')"
_GROUPS = [("2A00:1450", "2a00:1450", True), ("FD00:00AB", "fd00:ab", False), ("2001:0DB8", "2001:db8", False)]
_V6 = "CONCAT(CASE l_linenumber % 3 " + " ".join(f"WHEN {i} THEN '{g[0]}'" for i, g in enumerate(_GROUPS)) + " END, ':', lpad(hex(l_partkey % 4095 + 1), 4, '0'), ':0:0:0:0:', hex(l_suppkey % 4095 + 1))"
_KIND = f"CASE l_partkey % 5 WHEN 0 THEN concat('[', {_V4}, ']') WHEN 1 THEN concat(' IPv6:', {_V6}) WHEN 2 THEN concat('::ffff:', {_V4}) WHEN 3 THEN {_V6} ELSE 'not an address' END"


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with an address as a header might write it, of both versions."""
    li = table(spark, sf, "lineitem").select(*_KEYS, F.expr(_KIND).alias("raw"))
    return li.withColumn("a", N.address_of("raw"))


QUERIES = {
    "ip_norm": lambda s, d: addresses(s, d).select(*_KEYS, "a.address", "a.version"),
    "ip_public": lambda s, d: addresses(s, d).select(*_KEYS, F.col("a.public").alias("public")),
    "cidr_v6": lambda s, d: addresses(s, d).select(*_KEYS, N.within(F.col("raw"), F.lit("2a00:1400::/24")).alias("inside")),
    "rule_ladder": lambda s, d: judged(s, d).select(*_KEYS, "category", "reasons"),
    "attribution": _attribution,
    "routing_part": _routing,
    "intel_part": lambda s, d: carried(s, d).select(*_KEYS, F.round(S.intel_part(F.col("listed_ip"), F.col("tor"), F.col("listed_infra"), F.col("worst_related")), 6).alias("intel")),
    "pillar_url": lambda s, d: carried(s, d).select(*_KEYS, F.round(S.pillar_url(F.col("investment_scam"), F.col("lookalike"), F.col("age_days"), F.col("disposable"), F.col("p"), F.col("freemail"), F.col("resolves"), F.col("has_mx")), 6).alias("link")),
}

_CARRIED = "WITH m AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{x} AS {name}" for name, x in CARRIERS.items()) + " FROM lineitem)"
_JUDGED = (
    _CARRIED
    + """, c AS (
    SELECT *, credential_harvesting >= 0.5 AND credential_harvesting >= payment_diversion AND credential_harvesting >= fake_invoice AS creds FROM m
), r AS (
    SELECT *,
        concat_ws(',', CASE WHEN login_files > 0 THEN 'login_file' END, CASE WHEN critical_urls > 0 THEN 'critical_link' END, CASE WHEN harvest_link THEN 'harvest_link' END) AS hard,
        concat_ws(',', CASE WHEN NOT creds AND payment_diversion >= 0.5 THEN 'payment_diversion' END, CASE WHEN NOT creds AND fake_invoice >= 0.5 THEN 'fake_invoice' END,
            CASE WHEN extortion >= 0.5 THEN 'extortion' END, CASE WHEN investment_scam >= 0.5 THEN 'investment_scam' END, CASE WHEN callback_scam >= 0.5 THEN 'callback_scam' END,
            CASE WHEN payment_handles > 0 AND pushes > 0 AND NOT internal_sender THEN 'handles_and_push' END,
            CASE WHEN financial_terms >= 2 AND pressure > 0 AND risk >= 40 AND high_urls = 0 AND NOT creds THEN 'financial_lure' END,
            CASE WHEN model = 'Fraud-Related' AND p >= 0.6 AND financial_terms > 0 AND credential_harvesting < 0.5 AND high_urls = 0 THEN 'model_fraud' END,
            CASE WHEN executive_impersonation >= 0.5 AND financial_terms > 0 THEN 'executive_and_money' END) AS fraud,
        concat_ws(',', CASE WHEN credential_harvesting >= 0.5 THEN 'credential_harvesting' END, CASE WHEN high_urls > 0 AND credential_terms > 0 THEN 'high_link_and_credentials' END,
            CASE WHEN lookalike_link AND credential_terms + financial_terms + payment_handles > 0 THEN 'lookalike_link_and_request' END,
            CASE WHEN model = 'Phishing' AND p >= 0.6 AND medium_urls > 0 THEN 'model_phishing' END, CASE WHEN critical_files > 0 AND credential_terms > 0 THEN 'critical_file_and_credentials' END) AS phish,
        concat_ws(',', CASE WHEN display_spoof AND NOT brand_variant THEN 'display_spoof' END, CASE WHEN executive_impersonation >= 0.35 THEN 'executive_impersonation' END,
            CASE WHEN lookalike_other OR (lookalike_sender AND NOT brand_variant) THEN 'lookalike_sender' END, CASE WHEN protected AND (spf_fail OR dmarc_fail) THEN 'protected_domain_failed' END,
            CASE WHEN model = 'Impersonated' AND p >= 0.6 AND auth_failure THEN 'model_impersonated' END) AS imp,
        concat_ws(',', CASE WHEN violent_threat >= 0.5 THEN 'violent_threat' END, CASE WHEN risk >= 25 THEN 'risk' END, CASE WHEN severe_findings > 0 THEN 'severe_findings' END,
            CASE WHEN model <> 'Legitimate' AND p >= 0.6 THEN 'model_doubts' END) AS sus
    FROM c
), judged AS (
    SELECT *, CASE WHEN hard <> '' THEN 'Phishing' WHEN fraud <> '' THEN 'Fraud-Related' WHEN phish <> '' THEN 'Phishing' WHEN imp <> '' THEN 'Impersonated' WHEN sus <> '' THEN 'Suspicious' ELSE 'Legitimate' END AS category,
           CASE WHEN hard <> '' THEN hard WHEN fraud <> '' THEN fraud WHEN phish <> '' THEN phish WHEN imp <> '' THEN imp ELSE sus END AS reasons
    FROM r
)"""
)
_ROUTES = " + ".join(f"CASE WHEN {name} THEN {w} ELSE 0 END" for name, w in {"forged_received_order": 40, "negative_delay": 25, "large_delay": 10, "no_tls": 10, "helo_mismatch": 10, "unparseable": 5}.items())

_CANONICAL = "CASE l_linenumber % 3 " + " ".join(f"WHEN {i} THEN '{g[1]}'" for i, g in enumerate(_GROUPS)) + " END || ':' || lower(to_hex(l_partkey % 4095 + 1)) || '::' || lower(to_hex(l_suppkey % 4095 + 1))"
_ADDRESSES = f"""WITH a AS (
    SELECT l_orderkey, l_linenumber, l_partkey % 5 AS k, {_V4.replace("AS STRING", "AS VARCHAR")} AS v4, {_CANONICAL} AS v6, l_linenumber % 3 AS g,
           (1 + l_suppkey % 223) * 16777216 + (l_partkey % 256) * 65536 + 1 AS n FROM lineitem
), p AS (SELECT *, CASE WHEN k IN (0, 2) THEN NOT ({" OR ".join(f"n BETWEEN {N.number_of(a)} AND {N.number_of(a) + (1 << (32 - b)) - 1}" for a, b in N.NOT_PUBLIC)}) WHEN k IN (1, 3) THEN g = 0 END AS public FROM a)"""

ORACLE_SQL = {
    "ip_norm": _ADDRESSES + " SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 2) THEN v4 WHEN k IN (1, 3) THEN v6 END AS address, CAST(CASE WHEN k IN (0, 2) THEN 4 WHEN k IN (1, 3) THEN 6 END AS INTEGER) AS version FROM p",
    "ip_public": _ADDRESSES + " SELECT l_orderkey, l_linenumber, public FROM p",
    "cidr_v6": _ADDRESSES + " SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 2) THEN false WHEN k IN (1, 3) THEN g = 0 END AS inside FROM p",
    "rule_ladder": _JUDGED + " SELECT l_orderkey, l_linenumber, category, reasons FROM judged",
    "attribution": _JUDGED
    + """, s AS (
    SELECT *, CASE WHEN category = 'Legitimate' THEN 0 WHEN lookalike THEN 1 WHEN (spf_fail OR dmarc_fail OR auth_missing) AND (protected OR coalesce(age_days >= 365, false)) THEN 2
        WHEN spf_pass AND dkim_pass AND aligned AND category <> 'Suspicious' AND NOT freemail THEN 3 WHEN tor THEN 4 WHEN disposable THEN 5 WHEN age_days < 90 AND NOT freemail THEN 6 WHEN vpn THEN 7 WHEN hosting THEN 8
        WHEN freemail AND display_spoof THEN 9 WHEN freemail AND category IN ('Fraud-Related', 'Phishing') THEN 10 ELSE 11 END AS k FROM judged
) SELECT l_orderkey, l_linenumber, ['legitimate_sender', 'lookalike_domain', 'spoofed_domain', 'compromised_account', 'direct_attacker_infrastructure', 'undetermined'][CASE WHEN k <= 3 THEN k + 1 WHEN k <= 10 THEN 5 ELSE 6 END] AS source,
    CAST(CASE k WHEN 0 THEN least(1, p) WHEN 1 THEN CASE WHEN age_days < 90 THEN 0.9 ELSE 0.8 END WHEN 2 THEN CASE WHEN dmarc_fail THEN 0.85 ELSE 0.75 END WHEN 3 THEN 0.7 WHEN 4 THEN 0.85 WHEN 5 THEN 0.8 WHEN 6 THEN 0.75 WHEN 7 THEN 0.7 WHEN 8 THEN 0.65
        WHEN 9 THEN 0.6 WHEN 10 THEN 0.55 ELSE 0.3 END AS DOUBLE) AS confidence FROM s""",
    "routing_part": _CARRIED + f" SELECT l_orderkey, l_linenumber, CAST(least(100, {_ROUTES} + CASE WHEN n_hops = 0 THEN 25 WHEN NOT any_public THEN 20 ELSE 0 END + CASE WHEN origin_confidence < 0.5 THEN 10 ELSE 0 END) AS DOUBLE) AS routing FROM m",
    "intel_part": _CARRIED + " SELECT l_orderkey, l_linenumber, round(greatest(CASE WHEN tor THEN 85 WHEN listed_ip THEN 80 WHEN listed_infra THEN 75 ELSE 0 END, coalesce(40 + 0.4::DOUBLE * worst_related, 0))::DOUBLE, 6) AS intel FROM m",
    "pillar_url": _CARRIED
    + """, f AS (SELECT *, greatest(100 * investment_scam, CASE WHEN lookalike THEN 85 ELSE 0 END, CASE WHEN freemail THEN 0 WHEN age_days < 30 THEN 75 WHEN age_days < 90 THEN 50 ELSE 0 END, CASE WHEN disposable THEN 60 ELSE 0 END,
        CASE WHEN freemail THEN 0 WHEN NOT resolves THEN 70 WHEN NOT has_mx THEN 40 ELSE 0 END)::DOUBLE AS floor_ FROM m)
    SELECT l_orderkey, l_linenumber, round(least(100.0::DOUBLE, floor_ + (100 - floor_) * 0.5::DOUBLE * p), 6) AS link FROM f""",
}
