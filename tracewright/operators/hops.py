"""Delivery hops: delays over the last known time, anomalies, doubts so far, the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds: clock skew that is let pass, and the longest plausible delay.
SKEW, LONG = -60.0, 21_600.0


def with_delay(hops: DataFrame, key: str = "msg_id", idx: str = "idx", ts: str = "ts") -> DataFrame:
    """Adds delay: seconds since the last earlier hop that has a time; null for the first, and without a time."""
    before = Window.partitionBy(key).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return hops.withColumn("delay", (micros - F.last(micros, True).over(before)) / 1e6)


def anomalies(ts: Column, delay: Column, private: Column, plain: Column) -> Column:
    """Names of what is odd about a hop, in a fixed order. plain: a public hop without transport security."""
    tests = [("missing_timestamp", ts.isNull()), ("private_ip", private), ("negative_delay", delay < SKEW), ("large_delay", delay > LONG), ("no_tls", plain)]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests]))


def with_doubts(hops: DataFrame, key: str = "msg_id", idx: str = "idx") -> DataFrame:
    """Adds doubts: the distinct anomalies of this hop and all before it, sorted."""
    so_far = Window.partitionBy(key).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return hops.withColumn("doubts", F.array_sort(F.array_distinct(F.flatten(F.collect_list("anomalies").over(so_far)))))


def origin(hops: DataFrame, key: str = "msg_id") -> DataFrame:
    """The origin of each message and how sure it is.

    The first public hop from an outside host: 0.9, or 0.7 with doubts up to it; else the first public one: 0.4; else
    none: 0.0. hops: msg_id, idx, ip, public, internal, doubts.
    """
    outside = F.col("public") & ~F.col("internal")
    pick = lambda test: F.min(F.when(test, F.struct("idx", "ip", F.size("doubts").alias("n"))))
    found = hops.groupBy(key).agg(pick(outside).alias("a"), pick(F.col("public")).alias("b"))
    sure = F.when(F.col("a").isNotNull(), F.when(F.col("a.n") > 0, 0.7).otherwise(0.9)).when(F.col("b").isNotNull(), 0.4).otherwise(0.0)
    return found.select(key, F.coalesce("a.ip", "b.ip").alias("ip"), sure.alias("confidence"))


def boundary(hops: DataFrame, key: str = "msg_id") -> DataFrame:
    """The last public hop from an outside host."""
    return hops.where(F.col("public") & ~F.col("internal")).groupBy(key).agg(F.max_by("ip", "idx").alias("boundary_ip"))


def forged(hops: DataFrame, key: str = "msg_id", org_by: str = "org_by", org_from: str = "org_from") -> DataFrame:
    """Messages in which the organisation received a hop, and an outside public one follows before it sends any."""
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    decisive = F.when(F.col(org_from), F.lit(False)).when(F.col("public") & ~F.col("internal"), F.lit(True))
    nxt = F.first(decisive, ignorenulls=True).over(w)
    marked = hops.withColumn("_forged", F.col(org_by) & F.coalesce(nxt, F.lit(False)))
    return marked.groupBy(key).agg(F.bool_or("_forged").alias("forged"))
