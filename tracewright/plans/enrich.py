"""Queries of enrichment, reports and set operations, with the star schema as the carrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net as N
from ..functions import text as T
from ..operators import correlate as C
from ..operators import enrich as E
from ..session import table
from .cases import _CASES, cases
from .scoring import _COMPONENTS, _IND, indicators, strong_campaigns
from .texts import _IPS, _NUM, docs


def addresses(s: SparkSession, d: str) -> DataFrame:
    found = docs(s, d).select("doc_id", F.explode(F.array_distinct(T.found(F.col("text"), T.DOTTED_QUAD))).alias("ip"))
    return found.withColumn("n", N.ip_number(F.col("ip"))).where("n IS NOT NULL")


def places(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two tables that know some of the addresses."""
    one = addresses(s, d).groupBy("ip").agg(F.min("n").alias("n"))
    a = one.where("n % 3 = 0").select("ip", F.concat(F.lit("A"), (F.col("n") % 5).cast("string")).alias("country"))
    b = one.where("n % 2 = 0").select("ip", F.concat(F.lit("B"), (F.col("n") % 7).cast("string")).alias("country"))
    return a, b


def networks(s: SparkSession) -> DataFrame:
    rows = [(f"{a}.0.0.0/{b}",) for a in range(0, 256, 2) for b in (7, 8)] + [(f"{a}.128.0.0/10",) for a in range(0, 256, 3)]
    return s.createDataFrame(rows, "cidr string").withColumn("r", N.cidr_range(F.col("cidr"))).select("cidr", "r.lo", "r.hi")


_NETS = """nets AS (SELECT CAST(a AS VARCHAR) || '.0.0.0/7' AS cidr, (a - a % 2) * 16777216 AS lo, (a - a % 2) * 16777216 + 33554431 AS hi FROM range(0, 256, 2) t(a)
    UNION ALL SELECT CAST(a AS VARCHAR) || '.0.0.0/8', a * 16777216, a * 16777216 + 16777215 FROM range(0, 256, 2) t(a)
    UNION ALL SELECT CAST(a AS VARCHAR) || '.128.0.0/10', a * 16777216 + 8388608, a * 16777216 + 8388608 + 4194303 FROM range(0, 256, 3) t(a))"""


def spf_terms(s: SparkSession, d: str) -> DataFrame:
    """Nations as domains: each has networks, includes its region's domain, and ends in an 'all'; some regions include each other."""
    n = table(s, d, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey")
    row = lambda pos, q, m, v: F.struct(F.lit(pos).alias("pos"), F.lit(q).alias("qualifier"), F.lit(m).alias("mechanism"), v.alias("value"))
    own = n.select(F.concat(F.lit("n"), k).alias("domain"), F.explode(F.array(row(0, "+", "ip4", F.concat(F.lit("20."), k, F.lit(".0.0/16"))), row(1, "+", "include", F.concat(F.lit("r"), r.cast("string"))), row(2, "-", "all", F.lit("")))).alias("t"))
    reg = table(s, d, "region")
    q = F.col("r_regionkey")
    up = reg.select(F.concat(F.lit("r"), q.cast("string")).alias("domain"), F.explode(F.array(row(0, "+", "ip4", F.concat(F.lit("30."), q.cast("string"), F.lit(".0.0/16"))), row(1, "+", "include", F.concat(F.lit("r"), ((q + 1) % 5).cast("string"))), row(2, "~", "all", F.lit("")))).alias("t"))
    return own.union(up).select("domain", "t.*")


_SPF = """WITH RECURSIVE terms AS (
    SELECT 'n' || n_nationkey AS domain, '+' AS q, 'ip4' AS m, '20.' || n_nationkey || '.0.0/16' AS v FROM nation UNION ALL SELECT 'n' || n_nationkey, '+', 'include', 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey, '-', 'all', '' FROM nation
    UNION ALL SELECT 'r' || r_regionkey, '+', 'ip4', '30.' || r_regionkey || '.0.0/16' FROM region UNION ALL SELECT 'r' || r_regionkey, '+', 'include', 'r' || ((r_regionkey + 1) % 5) FROM region UNION ALL SELECT 'r' || r_regionkey, '~', 'all', '' FROM region
), walk(domain, here, via, steps) AS (
    SELECT DISTINCT domain, domain, CAST(NULL AS VARCHAR), 0 FROM terms
    UNION SELECT w.domain, t.v, coalesce(w.via, t.q), w.steps + 1 FROM walk w JOIN terms t ON t.domain = w.here WHERE t.m = 'include' AND w.steps < 9
)"""

_REPORT = {"Case": ["email_id", "category", "risk"], "Sender": ["sender", "country"]}


def _labels(s):
    return s.createDataFrame([("F", "closed"), ("O", "open"), ("P", "open")], "raw string, label string")


QUERIES = {
    "geo_lookup": lambda s, d: E.locate(addresses(s, d).select("doc_id", "ip"), list(zip(("city", "country"), places(s, d), strict=True))),
    "j_geo": lambda s, d: E.in_networks(addresses(s, d), networks(s)).select("doc_id", "ip", "cidr"),
    "geo_map": lambda s, d: table(s, d, "supplier").select("s_suppkey", E.asn_parts(F.concat(F.lit("AS"), F.col("s_suppkey").cast("string"), F.lit("  "), "s_name")).alias("p")).select("s_suppkey", "p.asn", "p.org"),
    "geo_tor": lambda s, d: addresses(s, d).select("doc_id", "ip").join(places(s, d)[0].select("ip"), "ip", "left_semi"),
    "geo_enrich": lambda s, d: E.capped(addresses(s, d).select("doc_id", "ip", "n"), "doc_id", [F.asc("n")], 2).select("doc_id", "ip"),
    "whois_date": lambda s, d: table(s, d, "orders").select("o_orderkey", E.registry_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy")).otherwise("n/a")).alias("registered")),
    "dom_analyse": lambda s, d: table(s, d, "orders").select(E.age_band(F.when(F.col("o_orderkey") % 10 != 0, F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date")))).alias("band")).groupBy("band").agg(F.count("*").alias("n")),
    "dom_reputation": lambda s, d: E.reputation(table(s, d, "supplier").select(F.col("s_name").alias("domain")), [("disposable", table(s, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_name").alias("domain"))), ("feed", table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_name").alias("domain")))]).select("domain", F.array_join("tags", ",").alias("tags")),
    "j_intel": lambda s, d: E.with_domain(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("domain"), F.col("c_name").alias("host")), table(s, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_name").alias("domain"), F.col("c_nationkey").alias("age_days")).union(s.createDataFrame([("BUILDING", 7)], "domain string, age_days int"))).select("c_custkey", "age_days"),
    "j_resolve": lambda s, d: table(s, d, "supplier").join(table(s, d, "customer"), F.col("s_nationkey") == F.col("c_nationkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")),
    "j_vt": lambda s, d: E.capped(table(s, d, "lineitem").where("l_quantity > 5").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey")], 4).select("l_orderkey", "l_linenumber", "p_brand"),
    "vt_parse": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).select("event_id", E.verdict_of_stats(F.col("k") % 5, F.col("k") % 2).alias("verdict")),
    "spf_eval": lambda s, d: E.spf_networks(spf_terms(s, d)).groupBy("domain", "qualifier", "cidr").agg(F.min("steps").alias("steps")),
    "auth_fuse": lambda s, d: table(s, d, "lineitem").select(F.element_at(F.array(*[F.lit(x) for x in ("pass", "fail", "none", "temperror")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("live"), F.when(F.col("l_suppkey") % 3 != 0, F.lower("l_returnflag")).alias("recorded")).select(E.fuse_spf(F.col("live"), F.col("recorded")).alias("spf")).groupBy("spf").agg(F.count("*").alias("n")),
    "dmarc_policy": lambda s, d: E.dmarc_policy(table(s, d, "nation").select(F.col("n_name").alias("domain"), F.col("n_regionkey").cast("string").alias("org")), s.createDataFrame([("0", "reject"), ("2", "none"), ("CHINA", "quarantine")], "domain string, policy string")).select("domain", "policy"),
    "canonical_json": lambda s, d: table(s, d, "nation").select("n_nationkey", E.canonical(["n_regionkey", "n_name", "n_nationkey"]).alias("json")),
    "sink_csv_report": lambda s, d: E.sections(cases(s, d), _REPORT, "email_id"),
    "report": lambda s, d: E.timeline([(cases(s, d).select("email_id", F.col("analyzed_at").alias("at")), "analyzed"), (table(s, d, "lineitem").select(F.col("l_orderkey").alias("email_id"), F.col("l_shipdate").cast("timestamp").alias("at")), "shipped")], "email_id", "at"),
    "actions": lambda s, d: cases(s, d).select("email_id", F.array_join(F.slice(F.array_distinct(F.array_compact(F.array(F.when(F.col("risk") >= 70, F.concat(F.lit("Block "), "sender")), F.when(F.col("category") == "Phishing", F.lit("Reset passwords")), F.when(F.col("risk") >= 25, F.lit("Report to the security team")), F.lit("Keep a record")))), 1, 10), "; ").alias("actions")),
    "ml_label_map": lambda s, d: E.relabel(table(s, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("raw")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("p")), _labels(s), ["o_custkey"]).select("o_custkey", "label", F.round("p", 6).alias("p")),
    "s_union": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))), ",").alias("merged")),
    "s_except": lambda s, d: indicators(s, d).groupBy("email_id").agg(F.size(F.array_except(F.collect_set("indicator"), F.collect_set(F.when(C.is_strong(F.col("indicator")), F.col("indicator"))))).alias("weak")),
    "s_intersect": lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_intersect(F.collect_set("o_orderpriority"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")))), ",").alias("both")),
    "s_distinct": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])), ",").alias("roles")),
    "campaign_name": lambda s, d: cases(s, d).groupBy("campaign_id").agg(F.coalesce(F.min(F.when(F.col("risk") > 90, F.col("sender"))), F.min(F.when(F.col("risk") > 50, T.subject_stem(F.col("subject")))), F.min("ip")).alias("name")),
    "campaign_repair": lambda s, d: E.dissolve(strong_campaigns(s, d), indicators(s, d).select("email_id").where("email_id % 2 = 0")),
    "custody_get": lambda s, d: table(s, d, "events").where("user_id = 7").select("event_id", "event_type", F.row_number().over(Window.orderBy("event_id")).alias("seq")),
    "url_b64_param": lambda s, d: table(s, d, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("b")).select("c_custkey", (F.length(F.regexp_replace(F.decode(F.try_to_binary("b", F.lit("base64")), "UTF-8"), r"[^\x20-\x7e]", "")) > 0.8 * F.length(F.decode(F.try_to_binary("b", F.lit("base64")), "UTF-8"))).alias("printable")),
    "text_norm": lambda s, d: docs(s, d).select("doc_id", F.substring(F.lower(T.collapse(F.translate("text", "‘’“”–—", "''\"\"--"))), 1, 200_000).alias("text")),
    "nlp_heur": lambda s, d: docs(s, d).select("doc_id", F.array_max(F.array(*[F.struct(F.size(T.lexicon_hits(F.regexp_replace("text", r"[^\x00-\x7f]", " "), words)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("label")) for k, (name, words) in enumerate({"Legitimate": ["the", "of"], "Phishing": ["idiot", "scum", "worthless"], "Suspicious": ["und", "der", "die"]}.items())])).alias("m")).select("doc_id", F.col("m.label").alias("label"), F.col("m.n").alias("n")),
}

#: RE2 takes ASCII alone for letters at a word's end, so the carrier is made plain on both sides.
_TEXT = "lower(regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g'))"


def _hits(words):
    return f"len(list_distinct(regexp_extract_all({_TEXT}, '{T.lexicon_pattern(words)}')))"


ORACLE_SQL = {
    "geo_lookup": f"WITH ips AS ({_IPS}), v AS {_NUM}, one AS (SELECT ip, min(n) AS n FROM v GROUP BY ip) SELECT v.doc_id, v.ip, CASE WHEN {' OR '.join(f'v.n BETWEEN {N.number_of(a)} AND {N.number_of(a) + (1 << (32 - b)) - 1}' for a, b in N.NOT_PUBLIC)} THEN '' WHEN v.n % 3 = 0 THEN 'A' || v.n % 5 WHEN v.n % 2 = 0 THEN 'B' || v.n % 7 ELSE '' END AS country, CASE WHEN {' OR '.join(f'v.n BETWEEN {N.number_of(a)} AND {N.number_of(a) + (1 << (32 - b)) - 1}' for a, b in N.NOT_PUBLIC)} THEN 'private' WHEN v.n % 3 = 0 THEN 'city' WHEN v.n % 2 = 0 THEN 'country' ELSE 'unavailable' END AS source FROM v",
    "j_geo": f"WITH ips AS ({_IPS}), v AS {_NUM}, {_NETS} SELECT doc_id, ip, arg_min(cidr, (hi - lo, cidr)) AS cidr FROM v JOIN nets ON n BETWEEN lo AND hi GROUP BY doc_id, ip, n",
    "geo_map": "SELECT s_suppkey, 'AS' || s_suppkey AS asn, s_name AS org FROM supplier",
    "geo_tor": f"WITH ips AS ({_IPS}), v AS {_NUM} SELECT doc_id, ip FROM v WHERE ip IN (SELECT ip FROM v WHERE n % 3 = 0)",
    "geo_enrich": f"WITH ips AS ({_IPS}), v AS {_NUM} SELECT doc_id, ip FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 2",
    "whois_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) WHEN o_orderkey % 3 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS registered FROM orders",
    "dom_analyse": "SELECT CASE WHEN d IS NULL THEN 'unknown' WHEN d < 30 THEN 'high' WHEN d < 90 THEN 'medium' WHEN d < 365 THEN 'low' ELSE 'info' END AS band, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-01') END AS d FROM orders) GROUP BY 1",
    "dom_reputation": "SELECT s_name AS domain, array_to_string(list_filter([CASE WHEN s_nationkey % 2 = 0 THEN 'disposable' END, CASE WHEN s_acctbal < 0 THEN 'feed' END], lambda x: x IS NOT NULL), ',') AS tags FROM supplier",
    "j_intel": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 7 WHEN c_custkey % 5 = 0 THEN c_nationkey END AS age_days FROM customer",
    "j_resolve": "SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey",
    "j_vt": "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 5 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 4",
    "vt_parse": "SELECT event_id, CASE WHEN k % 5 >= 3 THEN 'critical' WHEN k % 5 >= 1 THEN 'high' WHEN k % 2 >= 1 THEN 'medium' ELSE 'info' END AS verdict FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "spf_eval": _SPF + " SELECT domain, qualifier, cidr, min(steps) AS steps FROM (SELECT w.domain, coalesce(w.via, t.q) AS qualifier, CASE WHEN t.m = 'all' THEN '0.0.0.0/0' ELSE t.v END AS cidr, w.steps FROM walk w JOIN terms t ON t.domain = w.here WHERE t.m = 'ip4' OR (t.m = 'all' AND w.via IS NULL)) GROUP BY ALL",
    "auth_fuse": "SELECT CASE WHEN live IN ('pass', 'fail') THEN live WHEN recorded IS NOT NULL THEN recorded WHEN live = 'none' THEN live ELSE 'unverifiable' END AS spf, count(*) AS n FROM (SELECT ['pass', 'fail', 'none', 'temperror'][l_partkey % 4 + 1] AS live, CASE WHEN l_suppkey % 3 <> 0 THEN lower(l_returnflag) END AS recorded FROM lineitem) GROUP BY 1",
    "dmarc_policy": "SELECT n_name AS domain, CASE WHEN n_name = 'CHINA' THEN 'quarantine' WHEN n_regionkey = 0 THEN 'reject' ELSE 'none' END AS policy FROM nation",
    "canonical_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "sink_csv_report": _CASES + " SELECT email_id, CAST(pos AS INTEGER) AS pos, section, field, value FROM (SELECT email_id, unnest(range(5)) AS pos, unnest(['Case', 'Case', 'Case', 'Sender', 'Sender']) AS section, unnest(['email_id', 'category', 'risk', 'sender', 'country']) AS field, unnest([CAST(email_id AS VARCHAR), category, CAST(risk AS VARCHAR), sender, country]) AS value FROM cases)",
    "report": _CASES + ", e AS (SELECT email_id, analyzed_at AS at_, 'analyzed' AS what FROM cases UNION ALL SELECT l_orderkey, CAST(l_shipdate AS TIMESTAMP), 'shipped' FROM lineitem) SELECT email_id, at_ AS \"at\", what, CAST(row_number() OVER (PARTITION BY email_id ORDER BY at_, what) AS INTEGER) AS place FROM e",
    "actions": _CASES + " SELECT email_id, array_to_string(list_filter([CASE WHEN risk >= 70 THEN 'Block ' || sender END, CASE WHEN category = 'Phishing' THEN 'Reset passwords' END, CASE WHEN risk >= 25 THEN 'Report to the security team' END, 'Keep a record'], lambda x: x IS NOT NULL), '; ') AS actions FROM cases",
    "ml_label_map": "SELECT o_custkey, label, round(p / sum(p) OVER (PARTITION BY o_custkey), 6) AS p FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS label, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS p FROM orders GROUP BY ALL)",
    "s_union": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), ',') AS merged FROM lineitem GROUP BY 1",
    "s_except": _IND + " SELECT email_id, CAST(count(DISTINCT indicator) FILTER (NOT starts_with(indicator, 'sender:')) AS INTEGER) AS weak FROM own GROUP BY 1",
    "s_intersect": "SELECT o_custkey, array_to_string(list_sort(list_intersect(list(o_orderpriority), ['1-URGENT', '5-LOW'])), ',') AS \"both\" FROM orders GROUP BY 1",
    "s_distinct": "SELECT conv_id, string_agg(role, ',' ORDER BY first_) AS roles FROM (SELECT conv_id, role, min(turn) AS first_ FROM conversations GROUP BY ALL) GROUP BY conv_id",
    "campaign_name": _CASES + " SELECT campaign_id, coalesce(min(CASE WHEN risk > 90 THEN sender END), min(CASE WHEN risk > 50 THEN substring(replace(subject, 'Re: ', ''), 1, 40) END), min(ip)) AS name FROM cases GROUP BY campaign_id",
    "campaign_repair": _IND + _COMPONENTS + ", m AS (SELECT x AS email_id, min(y) AS campaign_id FROM reach GROUP BY x) SELECT email_id, campaign_id FROM m WHERE email_id % 2 <> 0 QUALIFY count(*) OVER (PARTITION BY campaign_id) >= 2",
    "custody_get": "SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS seq FROM events WHERE user_id = 7",
    "url_b64_param": "SELECT c_custkey, true AS printable FROM customer",
    "text_norm": "SELECT doc_id, substring(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 1, 200000) AS text FROM documents",
    "nlp_heur": f"SELECT doc_id, m.label AS label, CAST(m.n AS INTEGER) AS n FROM (SELECT doc_id, list_max([{{'n': {_hits(['the', 'of'])}, 'k': 0, 'label': 'Legitimate'}}, {{'n': {_hits(['idiot', 'scum', 'worthless'])}, 'k': -1, 'label': 'Phishing'}}, {{'n': {_hits(['und', 'der', 'die'])}, 'k': -2, 'label': 'Suspicious'}}]) AS m FROM documents)",
}
