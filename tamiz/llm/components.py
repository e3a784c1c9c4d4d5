"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import gathered, settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each node ``u`` links neighbours to its smallest neighbour (itself included).

    large: neighbours above ``u``; small: those below it. Edges are kept as (u > v) pairs.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root), root being the smallest node reachable.

    Nodes without an edge are not returned; loops and repeated edges are harmless. Each round is written to the
    shared folder, so that a lost executor repeats one round at most. A round lowers some node's neighbour or is the last, so rounds
    end; their number grows with the logarithm of the longest path.
    """
    now = settled("edges", lambda: edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = settled("edges", lambda last=gathered(now): _star(_star(last, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
