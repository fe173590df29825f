"""Queries of the case store, delivery hops and the ledger, with orders, customers and events as carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hops as H
from ..operators import ledger as L
from ..operators import retention as R
from ..operators import store as S
from ..session import table

NOW = "1998-08-02 00:00:00"
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases: an order is a message, its customer the sender, the nation the country."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    category = F.lit("Impersonated")
    for priority, name in zip(_PRIORITY, S.CATEGORIES, strict=True):
        category = F.when(F.col("o_orderpriority") == priority, name).otherwise(category)
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(
        F.col("o_orderkey").alias("email_id"),
        F.col("o_orderdate").cast("timestamp").alias("analyzed_at"),
        (F.floor("o_totalprice") % 101).cast("long").alias("risk"),
        category.alias("category"),
        F.col("n_name").alias("country"),
        F.col("o_orderstatus").alias("source_type"),
        F.col("c_name").alias("sender"),
        F.concat_ws(" ", F.lit("Re:"), "c_mktsegment", "o_orderpriority").alias("subject"),
        F.concat_ws(".", F.lit("10"), "c_nationkey", F.col("o_custkey") % 7, F.lit("1")).alias("ip"),
        (F.col("o_custkey") % 50).alias("campaign_id"),
    )


_CASES = """WITH cases AS (
    SELECT o_orderkey AS email_id, CAST(o_orderdate AS TIMESTAMP) AS analyzed_at, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Legitimate' WHEN '2-HIGH' THEN 'Suspicious' WHEN '3-MEDIUM' THEN 'Phishing' WHEN '4-NOT SPECIFIED' THEN 'Fraud-Related' ELSE 'Impersonated' END AS category,
           n_name AS country, o_orderstatus AS source_type, c_name AS sender, 'Re: ' || c_mktsegment || ' ' || o_orderpriority AS subject,
           '10.' || c_nationkey || '.' || (o_custkey % 7) || '.1' AS ip, o_custkey % 50 AS campaign_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """A retention row for each case: some unlisted, frozen, purged or without end."""
    k = F.col("email_id")
    c = cases(spark, sf).select("email_id", F.col("analyzed_at").alias("created_at"))
    none = F.lit(None).cast("timestamp")
    return c.select(
        "email_id",
        (k % 11 != 0).alias("listed"),
        "created_at",
        F.when(k % 5 != 0, F.col("created_at") + F.expr("INTERVAL 24 HOURS")).otherwise(none).alias("expires_at"),
        F.when(k % 7 == 0, F.col("created_at")).otherwise(none).alias("frozen_at"),
        F.when(k % 13 == 0, F.col("created_at")).otherwise(none).alias("purged_at"),
    )


_RETENTION = _CASES + """, retention AS (
    SELECT email_id, email_id % 11 <> 0 AS listed, analyzed_at AS created_at,
           CASE WHEN email_id % 5 <> 0 THEN analyzed_at + INTERVAL 24 HOUR END AS expires_at,
           CASE WHEN email_id % 7 = 0 THEN analyzed_at END AS frozen_at, CASE WHEN email_id % 13 = 0 THEN analyzed_at END AS purged_at
    FROM cases
)"""


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as events that set a case's status; a case is told by the part, so many have several and others none."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("email_id"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "blocked").when(F.col("l_returnflag") == "A", "quarantined").otherwise("open").alias("status"), F.col("l_shipdate").cast("timestamp").alias("set_at"), "l_orderkey")


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    newest = [F.desc("set_at"), F.desc("l_linenumber"), F.desc("l_orderkey"), F.desc("status")]
    return S.latest(status_events(spark, sf), ["email_id"], newest).select("email_id", "status", "set_at")


_STATUS = """SELECT email_id, status, set_at FROM (
    SELECT l_partkey AS email_id, CASE l_returnflag WHEN 'R' THEN 'blocked' WHEN 'A' THEN 'quarantined' ELSE 'open' END AS status, CAST(l_shipdate AS TIMESTAMP) AS set_at, l_linenumber, l_orderkey
    FROM lineitem
) QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY set_at DESC, l_linenumber DESC, l_orderkey DESC, status DESC) = 1"""


def event_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Events as delivery hops: a user is a message, its events in order of time are the hops; some have no time."""
    e = table(spark, sf, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("msg_id"),
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.when(k % 6 != 0, F.col("ts").cast("timestamp")).alias("ts"),
        F.concat_ws(".", F.lit("20"), k % 200, F.lit("0"), F.lit("1")).alias("ip"),
        (k % 3 != 0).alias("public"),
        (F.col("event_type") == "view").alias("internal"),
        (F.col("event_type") == "signup").alias("org_by"),
        (F.col("event_type") == "purchase").alias("org_from"),
        "event_type",
    )


_HOPS = """WITH hops AS (
    SELECT user_id AS msg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % 6 <> 0 THEN CAST(ts AS TIMESTAMP) END AS ts,
           '20.' || (event_id % 200) || '.0.1' AS ip, event_id % 3 <> 0 AS public, event_type = 'view' AS internal, event_type = 'signup' AS org_by, event_type = 'purchase' AS org_from, event_type
    FROM events
), delayed AS (
    SELECT *, epoch_us(ts) - last_value(epoch_us(ts) IGNORE NULLS) OVER (PARTITION BY msg_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS us FROM hops
), odd AS (
    SELECT *, us / 1e6 AS delay, list_filter([CASE WHEN ts IS NULL THEN 'missing_timestamp' END, CASE WHEN NOT public THEN 'private_ip' END, CASE WHEN us / 1e6 < -60 THEN 'negative_delay' END,
              CASE WHEN us / 1e6 > 21600 THEN 'large_delay' END, CASE WHEN event_type = 'error' THEN 'no_tls' END], lambda x: x IS NOT NULL) AS anomalies
    FROM delayed
), doubted AS (
    SELECT *, list_sort(list_distinct(flatten(list(anomalies) OVER (PARTITION BY msg_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) AS doubts FROM odd
)"""


def odd_hops(spark: SparkSession, sf: str) -> DataFrame:
    h = H.with_delay(event_hops(spark, sf))
    h = h.withColumn("anomalies", H.anomalies(F.col("ts"), F.col("delay"), ~F.col("public"), F.col("event_type") == "error"))
    return H.with_doubts(h)


def custody(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows, a ledger for each user."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").cast("string").alias("ledger"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_id").alias("email_id"), F.col("event_type").alias("action"), F.col("props").alias("detail"))


_FIELDS = ["email_id", "action", "detail"]


def chained(spark: SparkSession, sf: str) -> DataFrame:
    rows = custody(spark, sf)
    return rows.join(L.chain(rows, "ledger", _FIELDS), ["ledger", "seq"])


_CHAIN = """WITH RECURSIVE rows AS (
    SELECT CAST(user_id AS VARCHAR) AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, event_type, coalesce(props, '') AS props FROM events
), chain(ledger, seq, prev_hash, hash) AS (
    SELECT ledger, seq, repeat('0', 64), sha256(repeat('0', 64) || '|' || seq || '|' || event_id || '|' || event_type || '|' || props) FROM rows WHERE seq = 1
    UNION ALL
    SELECT r.ledger, r.seq, c.hash, sha256(c.hash || '|' || r.seq || '|' || r.event_id || '|' || r.event_type || '|' || r.props) FROM chain c JOIN rows r ON r.ledger = c.ledger AND r.seq = c.seq + 1
)"""


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Verification after a third of the ledgers had a row changed."""
    rows = chained(spark, sf).withColumn("detail", F.when((F.col("ledger").cast("long") % 3 == 0) & (F.col("seq") == 2), "changed").otherwise(F.col("detail")))
    return L.verify(rows, "ledger", _FIELDS)


def _c(f):
    return lambda spark, sf: f(cases(spark, sf))


QUERIES = {
    "list_cases": lambda s, d: S.page(S.filter_cases(cases(s, d), q="build%high", search=["subject", "sender", "country"], min_risk=40), 100, 5),
    "o_sort_page": _c(lambda c: S.page(c, 900, 20)),
    "agg_stats": _c(S.stats),
    "agg_total": _c(lambda c: S.filter_cases(c, category="Phishing", min_risk=30).agg(F.count("*").alias("total"))),
    "agg_category": _c(lambda c: S.by_category(c.where("category <> 'Phishing'"))),
    "agg_country": _c(S.top_countries),
    "agg_source": _c(S.by_source),
    "agg_origins": _c(lambda c: S.origins(c).orderBy(F.desc("n"), F.desc("max_risk"), "ip")),
    "agg_place": _c(lambda c: S.by_place(S.origins(c))),
    "agg_bump": _c(lambda c: c.groupBy(F.to_date("analyzed_at").cast("string").alias("day"), "category").agg(F.count("*").alias("n"))),
    "agg_maxsev": _c(lambda c: c.groupBy("campaign_id").agg(F.max_by(F.when(F.col("risk") >= 75, "critical").when(F.col("risk") >= 50, "high").otherwise("low"), "risk").alias("worst"))),
    "agg_campaign": _c(lambda c: c.groupBy("campaign_id").agg(F.count("*").alias("members"), F.max("risk").alias("max_risk"), F.count_if(F.col("category") == "Phishing").alias("phishing"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"))),
    "sink_upsert": latest_status,
    "j_status": lambda s, d: S.with_status(cases(s, d), latest_status(s, d)).select("email_id", "risk", "status"),
    "j_listed": lambda s, d: S.listed(cases(s, d), retention(s, d)).select("email_id", "category"),
    "j_backfill": lambda s, d: cases(s, d).select("email_id", "sender").join(status_events(s, d).select("email_id").distinct(), "email_id", "left_anti"),
    "j_exists": lambda s, d: cases(s, d).select("email_id").join(status_events(s, d).where("status = 'blocked'").select("email_id"), "email_id", "left_semi"),
    "j_inlist": lambda s, d: S.in_order(cases(s, d), [7, 3, 99, 1, 32, 5]).select("pos", "email_id", "risk", "category"),
    "o_alerts": _c(lambda c: S.raise_alerts(c).orderBy(F.desc("analyzed_at"), F.desc("email_id")).limit(50)),
    "o_export": _c(lambda c: S.export_cells(c.orderBy("email_id").limit(5000), ["email_id", "sender", "subject", "category", "risk"])),
    "o_campaigns": _c(lambda c: c.groupBy("campaign_id").agg(F.max("analyzed_at").alias("updated_at")).orderBy(F.desc("updated_at"), "campaign_id")),
    "o_incidents": _c(lambda c: c.where("risk > 95").select("email_id", "risk").orderBy(F.desc("risk"), "email_id")),
    "alert_raise": _c(S.raise_alerts),
    "alert_ack": lambda s, d: S.acknowledged(S.raise_alerts(cases(s, d)), status_events(s, d).where("status = 'blocked'")).select("email_id", "acknowledged"),
    "decision": lambda s, d: S.with_status(cases(s, d), latest_status(s, d)).where("status <> 'open'").select("email_id", "status", F.concat(F.col("status"), F.lit("_decision")).alias("action"), "sender"),
    "cache_ttl": lambda s, d: S.unexpired(retention(s, d), F.lit(NOW).cast("timestamp")).select("email_id", "expires_at"),
    "cache_lru": lambda s, d: S.lru(table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "user_id", 40),
    "retention_plan": lambda s, d: R.plan(cases(s, d).select("email_id", "analyzed_at", F.col("source_type").alias("origin"), F.when(F.col("risk") % 4 > 0, F.col("risk") * 3 - 30).alias("hours")), permanent=("P",)),
    "retention_state": lambda s, d: R.state(retention(s, d), F.lit(NOW).cast("timestamp")),
    "retention_sweep": lambda s, d: R.sweep(cases(s, d), R.due(retention(s, d), F.lit(NOW).cast("timestamp"))).select("email_id", "risk"),
    "freeze": lambda s, d: R.freeze(retention(s, d), status_events(s, d).where("status = 'blocked'"), F.lit(NOW).cast("timestamp")),
    "st_retention": lambda s, d: retention(s, d).where("expires_at IS NOT NULL AND frozen_at IS NULL AND purged_at IS NULL").select("email_id", "expires_at"),
    "w_delay": lambda s, d: H.with_delay(event_hops(s, d)).select("msg_id", "idx", F.round("delay", 3).alias("delay")),
    "hop_build": lambda s, d: odd_hops(s, d).select("msg_id", "idx", F.array_join("anomalies", ",").alias("anomalies")),
    "w_doubts": lambda s, d: odd_hops(s, d).select("msg_id", "idx", F.array_join("doubts", ",").alias("doubts")),
    "origin_select": lambda s, d: H.origin(odd_hops(s, d)),
    "auth_boundary": lambda s, d: H.boundary(event_hops(s, d)),
    "hop_forged": lambda s, d: H.forged(event_hops(s, d)),
    "w_first": lambda s, d: S.latest(event_hops(s, d).where("public"), ["msg_id"], [F.asc("idx")]).select("msg_id", "idx", "ip"),
    "w_cap": lambda s, d: event_hops(s, d).where("idx < 6").select("msg_id", "idx", "ip"),
    "w_chain": lambda s, d: L.chain(custody(s, d), "ledger", _FIELDS),
    "w_verify": tampered,
}

ORACLE_SQL = {
    "list_cases": _CASES + " SELECT * FROM cases WHERE (lower(subject) LIKE '%build%high%' OR lower(sender) LIKE '%build%high%' OR lower(country) LIKE '%build%high%') AND risk >= 40 ORDER BY analyzed_at DESC, email_id DESC LIMIT 100 OFFSET 5",
    "o_sort_page": _CASES + " SELECT * FROM cases ORDER BY analyzed_at DESC, email_id DESC LIMIT 500 OFFSET 20",
    "agg_stats": _CASES + " SELECT count(*) AS total, count(*) FILTER (risk >= 70) AS high_risk, count(DISTINCT campaign_id) AS campaigns, round_even(coalesce(avg(risk), 0), 1) AS avg_risk FROM cases",
    "agg_total": _CASES + " SELECT count(*) AS total FROM cases WHERE category = 'Phishing' AND risk >= 30",
    "agg_category": _CASES + " SELECT c AS category, count(email_id) AS n FROM (SELECT unnest(['Legitimate', 'Suspicious', 'Phishing', 'Fraud-Related', 'Impersonated']) AS c) LEFT JOIN (SELECT * FROM cases WHERE category <> 'Phishing') ON category = c GROUP BY c",
    "agg_country": _CASES + " SELECT country, count(*) AS n FROM cases WHERE country <> '' GROUP BY country ORDER BY n DESC, country LIMIT 5",
    "agg_source": _CASES + " SELECT source_type, count(*) AS n FROM cases GROUP BY source_type",
    "agg_origins": _CASES + " SELECT ip, count(*) AS n, max(risk) AS max_risk, arg_max(country, (analyzed_at, email_id)) AS country FROM (SELECT * FROM cases WHERE ip <> '' ORDER BY analyzed_at DESC, email_id DESC LIMIT 500) GROUP BY ip",
    "agg_place": _CASES + " SELECT country, CAST(sum(n) AS BIGINT) AS n, max(max_risk) AS max_risk, count(*) AS addresses FROM (SELECT ip, count(*) AS n, max(risk) AS max_risk, arg_max(country, (analyzed_at, email_id)) AS country FROM (SELECT * FROM cases WHERE ip <> '' ORDER BY analyzed_at DESC, email_id DESC LIMIT 500) GROUP BY ip) GROUP BY country",
    "agg_bump": _CASES + " SELECT CAST(CAST(analyzed_at AS DATE) AS VARCHAR) AS day, category, count(*) AS n FROM cases GROUP BY ALL",
    "agg_maxsev": _CASES + " SELECT campaign_id, CASE WHEN max(risk) >= 75 THEN 'critical' WHEN max(risk) >= 50 THEN 'high' ELSE 'low' END AS worst FROM cases GROUP BY campaign_id",
    "agg_campaign": _CASES + " SELECT campaign_id, count(*) AS members, max(risk) AS max_risk, count(*) FILTER (category = 'Phishing') AS phishing, array_to_string(list_sort(list(DISTINCT country)), ',') AS countries FROM cases GROUP BY campaign_id",
    "sink_upsert": _STATUS,
    "j_status": _CASES + f", st AS ({_STATUS}) SELECT email_id, risk, coalesce(status, 'open') AS status FROM cases LEFT JOIN st USING (email_id)",
    "j_listed": _RETENTION + " SELECT email_id, category FROM cases c WHERE NOT EXISTS (SELECT 1 FROM retention r WHERE r.email_id = c.email_id AND NOT r.listed)",
    "j_backfill": _CASES + " SELECT email_id, sender FROM cases WHERE email_id NOT IN (SELECT l_partkey FROM lineitem)",
    "j_exists": _CASES + " SELECT email_id FROM cases WHERE email_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "j_inlist": _CASES + " SELECT CAST(pos AS INTEGER) AS pos, email_id, risk, category FROM cases JOIN (SELECT unnest([7, 3, 99, 1, 32, 5]) AS email_id, unnest(range(6)) AS pos) USING (email_id)",
    "o_alerts": _CASES + " SELECT email_id, analyzed_at, category, risk, CASE WHEN risk >= 75 THEN 'critical' ELSE 'high' END AS severity, false AS acknowledged FROM cases WHERE risk >= 70 ORDER BY analyzed_at DESC, email_id DESC LIMIT 50",
    "o_export": _CASES + " SELECT CAST(email_id AS VARCHAR) AS email_id, sender, subject, category, CAST(risk AS VARCHAR) AS risk FROM cases ORDER BY cases.email_id LIMIT 5000",
    "o_campaigns": _CASES + " SELECT campaign_id, max(analyzed_at) AS updated_at FROM cases GROUP BY campaign_id",
    "o_incidents": _CASES + " SELECT email_id, risk FROM cases WHERE risk > 95",
    "alert_raise": _CASES + " SELECT email_id, analyzed_at, category, risk, CASE WHEN risk >= 75 THEN 'critical' ELSE 'high' END AS severity, false AS acknowledged FROM cases WHERE risk >= 70",
    "alert_ack": _CASES + " SELECT email_id, email_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS acknowledged FROM cases WHERE risk >= 70",
    "decision": _CASES + f", st AS ({_STATUS}) SELECT email_id, status, status || '_decision' AS action, sender FROM cases JOIN st USING (email_id) WHERE status <> 'open'",
    "cache_ttl": _RETENTION + f" SELECT email_id, expires_at FROM retention WHERE expires_at >= TIMESTAMP '{NOW}'",
    "cache_lru": "SELECT user_id, CAST(max(ts) AS TIMESTAMP) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 40",
    "retention_plan": _CASES + " SELECT email_id, coalesce(h > 168 OR h < 1, false) AS rejected, CASE WHEN h BETWEEN 1 AND 168 THEN analyzed_at + to_hours(CAST(h AS INTEGER)) WHEN h IS NULL AND source_type <> 'P' THEN analyzed_at + INTERVAL 24 HOUR END AS expires_at FROM (SELECT *, CASE WHEN risk % 4 > 0 THEN risk * 3 - 30 END AS h FROM cases)",
    "retention_state": _RETENTION + f" SELECT email_id, CASE WHEN purged_at IS NOT NULL THEN 'purged' WHEN frozen_at IS NOT NULL THEN 'frozen' WHEN expires_at IS NOT NULL THEN 'expiring' ELSE 'permanent' END AS state, CASE WHEN purged_at IS NULL AND frozen_at IS NULL AND expires_at IS NOT NULL THEN greatest(0, CAST(epoch(expires_at) - epoch(TIMESTAMP '{NOW}') AS BIGINT)) END AS seconds_left FROM retention",
    "retention_sweep": _RETENTION + f" SELECT email_id, risk FROM cases WHERE email_id NOT IN (SELECT email_id FROM retention WHERE expires_at < TIMESTAMP '{NOW}' AND frozen_at IS NULL AND purged_at IS NULL)",
    "freeze": _RETENTION + f" SELECT email_id, CASE WHEN frozen_at IS NULL AND purged_at IS NULL AND expires_at IS NOT NULL AND email_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN TIMESTAMP '{NOW}' ELSE frozen_at END AS frozen_at FROM retention",
    "st_retention": _RETENTION + " SELECT email_id, expires_at FROM retention WHERE expires_at IS NOT NULL AND frozen_at IS NULL AND purged_at IS NULL",
    "w_delay": _HOPS + " SELECT msg_id, idx, round(delay, 3) AS delay FROM odd",
    "hop_build": _HOPS + " SELECT msg_id, idx, array_to_string(anomalies, ',') AS anomalies FROM odd",
    "w_doubts": _HOPS + " SELECT msg_id, idx, array_to_string(doubts, ',') AS doubts FROM doubted",
    "origin_select": _HOPS + """, a AS (SELECT msg_id, arg_min(ip, idx) AS ip, arg_min(len(doubts), idx) AS n FROM doubted WHERE public AND NOT internal GROUP BY msg_id), b AS (SELECT msg_id, arg_min(ip, idx) AS ip FROM doubted WHERE public GROUP BY msg_id)
        SELECT m.msg_id, coalesce(a.ip, b.ip) AS ip, CASE WHEN a.ip IS NOT NULL THEN CASE WHEN a.n > 0 THEN 0.7 ELSE 0.9 END WHEN b.ip IS NOT NULL THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT DISTINCT msg_id FROM hops) m LEFT JOIN a USING (msg_id) LEFT JOIN b USING (msg_id)""",
    "auth_boundary": _HOPS + " SELECT msg_id, arg_max(ip, idx) AS boundary_ip FROM hops WHERE public AND NOT internal GROUP BY msg_id",
    "hop_forged": _HOPS + """, d AS (SELECT *, CASE WHEN org_from THEN false WHEN public AND NOT internal THEN true END AS decisive FROM hops), n AS (SELECT *, first_value(decisive IGNORE NULLS) OVER (PARTITION BY msg_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM d)
        SELECT msg_id, bool_or(org_by AND coalesce(nxt, false)) AS forged FROM n GROUP BY msg_id""",
    "w_first": _HOPS + " SELECT msg_id, min(idx) AS idx, arg_min(ip, idx) AS ip FROM hops WHERE public GROUP BY msg_id",
    "w_cap": _HOPS + " SELECT msg_id, idx, ip FROM hops WHERE idx < 6",
    "w_chain": _CHAIN + " SELECT * FROM chain",
    "w_verify": _CHAIN + """ SELECT ledger, NOT (CAST(ledger AS BIGINT) % 3 = 0 AND max(seq) >= 2) AS valid,
        CASE WHEN CAST(ledger AS BIGINT) % 3 = 0 AND max(seq) >= 2 THEN max(CASE WHEN seq = 2 THEN prev_hash END) ELSE arg_max(hash, seq) END AS head FROM chain GROUP BY ledger""",
}
