"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Edges that a task takes at least. Without it a short table leaves many tiny files in every round.
EDGES_A_TASK = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge to another; label is the smallest node reachable.

    Alternates the large-star and small-star steps, each a grouped minimum and a join, until the edges are stars.
    A hub's neighbours are never gathered in one row or task: the minimum is combined before the shuffle and the
    join may split a hot key. Each round is cut off in the shared folder, in as many parts as its edges ask for. Loops and
    repeated edges do no harm.
    """
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen, n = None, pairs.count()
    for _ in range(most_rounds):
        parts = 1 + n // EDGES_A_TASK
        both = pairs.union(pairs.select("v", "u")).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).coalesce(parts).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = cut(small.union(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v"), F.col("v")).distinct())
