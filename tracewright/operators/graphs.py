"""Attribution graphs: typed nodes and edges of messages, merged over the members of a campaign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: str, key: Column) -> Column:
    """'<kind>:<key>', so that graphs of different messages lie over each other."""
    return F.concat(F.lit(f"{kind}:"), F.lower(key.cast("string")))


def nodes(parts: list[tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """(graph, id, kind, risk) of several selections: rows with a column graph, the kind, the key and a risk."""
    each = [df.select("graph", node_id(kind, key).alias("id"), F.lit(kind).alias("kind"), risk.cast("int").alias("risk")) for df, kind, key, risk in parts]
    return reduce(DataFrame.unionByName, each)


def edges(parts: list[tuple[DataFrame, Column, Column, str]]) -> DataFrame:
    """(graph, source, target, relation), distinct."""
    each = [df.select("graph", a.alias("source"), b.alias("target"), F.lit(relation).alias("relation")) for df, a, b, relation in parts]
    return reduce(DataFrame.unionByName, each).distinct()


def merged(of: DataFrame) -> DataFrame:
    """One row per node over all graphs: the highest risk and how many graphs share it."""
    return of.groupBy("id", "kind").agg(F.max("risk").alias("risk"), F.countDistinct("graph").alias("graphs"))


def shared(of: DataFrame, least: int = 2) -> DataFrame:
    """Nodes that at least so many graphs hold."""
    return merged(of).where(F.col("graphs") >= least)


def reach(of: DataFrame, start: Column, hops: int = 2) -> DataFrame:
    """(id, hops): nodes within some steps of the nodes that satisfy `start`; a join for each step, edges both ways."""
    both = of.select("source", "target").union(of.select(F.col("target"), F.col("source"))).distinct()
    seen = both.select(F.col("source").alias("id")).distinct().where(start).select("id", F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        found = seen.where(F.col("hops") == k - 1).join(both, F.col("id") == F.col("source")).select(F.col("target").alias("id"), F.lit(k).alias("hops"))
        seen = seen.union(found).groupBy("id").agg(F.min("hops").alias("hops"))
    return seen
