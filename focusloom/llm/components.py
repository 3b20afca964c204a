"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from focusloom.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether an end has two neighbours below it, or one below and one above: until then each is a member with its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.agg(F.max(F.col("below") + F.col("above") * F.least("below", F.lit(1)))).first()[0] not in (None, 0, 1)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges(u, v); component: the smallest id reachable.

    Each round is written to the shared folder; it was the last if its edges are
    stars, so edges that come as stars take no round. Groups are aggregated before
    they are shuffled, and the joins are ones that Spark can split when a node
    has very many neighbours.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _unfinished(now):
        after = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
