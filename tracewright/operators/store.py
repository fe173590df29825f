"""The case store: lists, counts, joins of events, latest rows, caches and exports, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_guard

CATEGORIES = ["Legitimate", "Suspicious", "Phishing", "Fraud-Related", "Impersonated"]
MOST_LISTED = 500
HIGH_RISK = 70


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: what a table holds after upserts. order: newest first, ties included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def like_any(q: str, columns: list[str]) -> Column:
    """Case-insensitive LIKE over several columns; '%' and '_' in q are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).like(f"%{q.lower()}%"), F.lit(False))
    return out


def filter_cases(cases: DataFrame, q: str = "", search: list[str] | None = None, category: str = "", min_risk: int = 0, source: str = "", campaign: str = "") -> DataFrame:
    """Rows that satisfy all filters given; the predicates reach the scan."""
    out = cases
    if q:
        out = out.where(like_any(q, search or ["subject", "sender"]))
    if category:
        out = out.where(F.col("category") == category)
    if min_risk:
        out = out.where(F.col("risk") >= min_risk)
    if source:
        out = out.where(F.col("source_type") == source)
    if campaign:
        out = out.where(F.col("campaign_id") == campaign)
    return out


def page(cases: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, ties by id descending; the limit is held within 1 and MOST_LISTED."""
    return cases.orderBy(F.desc("analyzed_at"), F.desc("email_id")).offset(max(0, offset)).limit(min(MOST_LISTED, max(1, limit)))


def with_status(cases: DataFrame, status: DataFrame) -> DataFrame:
    """Left join of the status table; a case without one is open."""
    return cases.join(status.select("email_id", "status"), "email_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def listed(cases: DataFrame, retention: DataFrame) -> DataFrame:
    """Cases without an unlisted retention row."""
    return cases.join(retention.where("not listed").select("email_id"), "email_id", "left_anti")


def in_order(cases: DataFrame, ids: list[int]) -> DataFrame:
    """The cases of a list of ids, in the list's order. The list comes from a caller, so it is small and broadcast."""
    wanted = cases.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "email_id long, pos int")
    return cases.join(F.broadcast(wanted), "email_id").orderBy("pos")


def stats(cases: DataFrame, open_alerts: Column | None = None) -> DataFrame:
    """One row: total, high risk, campaigns, mean risk rounded half to even at one place."""
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("risk") >= HIGH_RISK).alias("high_risk"),
        F.countDistinct("campaign_id").alias("campaigns"),
        F.bround(F.coalesce(F.avg("risk"), F.lit(0.0)), 1).alias("avg_risk"),
    )


def by_category(cases: DataFrame) -> DataFrame:
    """Counts by category, with a 0 for those without a case."""
    names = cases.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = cases.groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def top_countries(cases: DataFrame, k: int = 5) -> DataFrame:
    """The countries of most cases; ties by name."""
    return cases.where("country <> ''").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(k)


def by_source(cases: DataFrame) -> DataFrame:
    return cases.groupBy("source_type").agg(F.count("*").alias("n"))


def origins(cases: DataFrame, newest: int = MOST_LISTED) -> DataFrame:
    """Of the newest located cases, by address: how many, their highest risk and the place of the newest one."""
    recent = cases.where("ip <> ''").orderBy(F.desc("analyzed_at"), F.desc("email_id")).limit(newest)
    last = F.struct("analyzed_at", "email_id")
    return recent.groupBy("ip").agg(F.count("*").alias("n"), F.max("risk").alias("max_risk"), F.max_by("country", last).alias("country"))


def by_place(of: DataFrame) -> DataFrame:
    """Origins rolled up by place."""
    return of.groupBy("country").agg(F.sum("n").alias("n"), F.max("max_risk").alias("max_risk"), F.count("*").alias("addresses"))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that still hold at `now`."""
    return cache.where(F.col("expires_at") >= now)


def lru(cache: DataFrame, used: str, key: str, most: int) -> DataFrame:
    """The `most` keys used last; one row each, ties by key."""
    last = cache.groupBy(key).agg(F.max(used).alias("last_used"))
    return last.orderBy(F.desc("last_used"), key).limit(most)


def raise_alerts(cases: DataFrame, threshold: int = HIGH_RISK) -> DataFrame:
    """An alert for each case at or over the threshold; works on batches and on streams."""
    severity = F.when(F.col("risk") >= 75, "critical").when(F.col("risk") >= 50, "high").otherwise("medium")
    return cases.where(F.col("risk") >= threshold).select("email_id", "analyzed_at", "category", "risk", severity.alias("severity"), F.lit(False).alias("acknowledged"))


def acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with those acknowledged that an acknowledgement names."""
    marks = acks.select("email_id", F.lit(True).alias("_ack")).distinct()
    return alerts.join(marks, "email_id", "left").withColumn("acknowledged", F.coalesce("_ack", F.lit(False))).drop("_ack")


def export_cells(cases: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as guarded text cells, as a CSV sink writes them."""
    return cases.select(*[csv_guard(F.col(c).cast("string")).alias(c) for c in columns])


def write_csv(cells: DataFrame, path: str) -> None:
    """One header and CRLF line ends in each part; parts are written where they are computed."""
    cells.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
