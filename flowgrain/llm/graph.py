"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: point the larger (or the smaller) neighbours of a node at the least
    node of its neighbourhood."""
    if larger:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    both = near.join(least, "u")
    if larger:
        made = both.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        made = both.select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            least.select("u", F.col("low").alias("v")))
    return made.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v), root being the least
    node that can be reached. Null ends are dropped; an empty table gives an empty one.

    Alternating star steps: each is a grouped minimum (combined before the shuffle, so a hub
    is no hot task) and a join back; the state of a round is a table in the shared folder, so
    lineage stays short. Rounds grow with the logarithm of the longest chain.
    """
    state = store(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
                  .select("u", "v").distinct())
    mark = None
    while True:
        now = state.agg(F.count("*").alias("n"),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or (now["n"], now["s"]) == mark:
            break
        mark = (now["n"], now["s"])
        made = store(_stars(_stars(state, True), False))
        release(state)
        state = made
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
