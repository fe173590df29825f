"""Retention: plans, states against a given clock, sweeping, freezing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours that a temporary case is kept by default, and at most.
DEFAULT_HOURS, MOST_HOURS = 24, 168


def plan(cases: DataFrame, permanent: tuple[str, ...] = ("dashboard",), most: int = MOST_HOURS, default: int = DEFAULT_HOURS) -> DataFrame:
    """(email_id, expires_at, rejected) of cases with the columns email_id, analyzed_at, origin, hours.

    A case expires after the hours asked for. Where none are, cases of the permanent origins are kept for good, and others
    for the default. More hours than `most`, or less than one, are rejected, and nothing is planned.
    """
    hours = F.coalesce(F.col("hours"), F.when(~F.coalesce(F.col("origin").isin(*permanent), F.lit(False)), default))
    rejected = F.coalesce((F.col("hours") > most) | (F.col("hours") < 1), F.lit(False))
    after = F.timestamp_seconds(F.unix_seconds("analyzed_at") + hours * 3600)
    return cases.select("email_id", F.when(~rejected, after).alias("expires_at"), rejected.alias("rejected"))


def state(retention: DataFrame, now: Column) -> DataFrame:
    """(email_id, state, seconds_left): purged before frozen before expiring before permanent."""
    name = F.when(F.col("purged_at").isNotNull(), "purged").when(F.col("frozen_at").isNotNull(), "frozen").when(F.col("expires_at").isNotNull(), "expiring").otherwise("permanent")
    left = F.greatest(F.lit(0), F.unix_seconds("expires_at") - F.unix_seconds(now)).cast("long")
    return retention.select("email_id", name.alias("state"), F.when(name == "expiring", left).alias("seconds_left"))


def due(retention: DataFrame, now: Column) -> DataFrame:
    """Rows that have expired, are not frozen and not purged yet."""
    return retention.where((F.col("expires_at") < now) & F.col("frozen_at").isNull() & F.col("purged_at").isNull())


def sweep(table: DataFrame, gone: DataFrame, key: str = "email_id") -> DataFrame:
    """A table without the rows of purged cases; the same for each table of the store."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def freeze(retention: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """(email_id, frozen_at): expiring rows that somebody asked to keep are frozen at `now`."""
    marks = asked.select("email_id", F.lit(True).alias("_asked")).distinct()
    can = F.col("frozen_at").isNull() & F.col("purged_at").isNull() & F.col("expires_at").isNotNull() & F.col("_asked")
    return retention.join(marks, "email_id", "left").select("email_id", F.when(can, now).otherwise(F.col("frozen_at")).alias("frozen_at"))
