"""Positions of rows in a given order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import cut


def positions(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``: a row's place in its ``group`` (a column without nulls) by ``order``, from 0 without gaps.

    Rows are dealt by ranges of (group, order) and sorted there; a partition's rows of a group are counted, and the counts before it are
    added. So a group may span any number of partitions. Rows that ``order`` can't tell apart get places of their own, in any order.
    """
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, [group, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
