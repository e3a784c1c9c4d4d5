"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import written


def _linked(edges: DataFrame, every: bool) -> DataFrame:
    """Edges (a > b) in which each node's neighbours, those above it or (not ``every``) those below it, are tied to its least neighbour."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if every else edges
    least = sides.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    met = sides.join(least, "a")
    moved = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if every else met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(met.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of ``edges`` (a, b): the least node that each can reach. Rounds are about the logarithm of the longest path; each is written. Nodes without an edge to another are not returned."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = written(_linked(_linked(now, True), False), "edges")
        before, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
