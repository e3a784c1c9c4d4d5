"""Record linkage whose outcome depends on order: first match against kept records, several keys each (WIN-05)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.operators import graphs
from tamiz.session import written

#: Records of a component that one task folds in order; larger ones are decided in rounds over the whole table.
TOGETHER = 20_000


def fold(positions: list[int], keys: list[list[str]]) -> list[tuple[int, int, str | None]]:
    """(position, kept_position, matched) of records in order: one that shares a key with a kept one points to it by its most trusted such key."""
    owners: dict[str, int] = {}
    out = []
    for position, own in zip(positions, keys, strict=True):
        hit = next((k for k in own if k in owners), None)
        if hit is None:
            owners.update(dict.fromkeys(own, position))
        out.append((position, position if hit is None else owners[hit], hit))
    return out


def _folded(records: DataFrame) -> DataFrame:
    """Records (root, block, position, keys) of small components, each folded in one row."""

    @F.pandas_udf("array<struct<position long, kept long, matched string>>")
    def folded(rows: pd.Series) -> pd.Series:
        return pd.Series([[{"position": p, "kept": k, "matched": m} for p, k, m in fold([x["position"] for x in row], [list(x["keys"]) for x in row])] for row in rows])

    sorted_ = F.array_sort(F.collect_list(F.struct("position", "keys")))
    told = records.groupBy("root").agg(F.first("block").alias("block"), sorted_.alias("rows")).select("block", F.explode(folded("rows")).alias("x"))
    return told.select("block", "x.position", F.col("x.kept").alias("kept_position"), "x.matched")


def _in_rounds(records: DataFrame) -> DataFrame:
    """Records (block, position, keys) decided over the whole table: of the undecided, those that come first for all their keys are kept, and those that share a key with a kept one are dropped."""
    each = written(records.select("block", "position", F.posexplode("keys").alias("trust", "key")), "giants")
    left, owners = each.select("block", "position", "key"), None
    while not left.isEmpty():  # each round decides the first undecided record at least
        firsts = left.groupBy("block", "key").agg(F.min("position").alias("first"))
        ahead = left.join(firsts, ["block", "key"]).groupBy("block", "position").agg(F.min((F.col("position") == F.col("first")).cast("int")).alias("ok")).where("ok = 1")
        new = written(left.join(ahead.select("block", "position"), ["block", "position"]), "kept")
        owners = new if owners is None else owners.unionByName(new)
        gone = left.join(new.select("block", "key"), ["block", "key"], "left_semi").select("block", "position").distinct()
        left = written(left.join(gone, ["block", "position"], "left_anti"), "left")
    if owners is None:
        return records.select("block", "position", F.col("position").alias("kept_position"), F.lit(None).cast("string").alias("matched"))
    seen = each.join(owners.withColumnRenamed("position", "owner"), ["block", "key"]).where("owner <= position")
    hit = seen.groupBy("block", "position").agg(F.min(F.struct("trust", "key", "owner")).alias("hit"))
    return hit.select("block", "position", F.col("hit.owner").alias("kept_position"), F.when(F.col("hit.owner") != F.col("position"), F.col("hit.key")).alias("matched"))


def dedup(records: DataFrame, block: str, together: int = TOGETHER) -> DataFrame:
    """(block, position, kept_position, matched): records by position within a block; one that shares a key (``matched``) with a kept one is dropped and points to it.

    A dropped record's other keys are not remembered, so this is not the same as connected components. But only records of one component of
    the graph of shared keys can matter to each other: components of up to ``together`` records are folded in order, each in one task, and
    only larger ones take rounds. (block, position) is unique; records without a key, or that share none, are kept.
    """
    made = F.transform(text.record_keys(F.col("doi"), F.col("id"), F.col("title")), lambda x: F.concat_ws(":", x["kind"], x["v"]))
    keyed = written(records.select(F.col(block).alias("block"), F.col("position").cast("long").alias("position"), made.alias("keys"), F.monotonically_increasing_id().alias("node")), "keyed")
    each = keyed.select("block", "node", F.explode("keys").alias("key"))
    shared = each.groupBy("block", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    roots = graphs.components(each.join(shared, ["block", "key"]).select(F.col("node").alias("a"), "b"))
    placed = written(keyed.join(roots, "node", "left"), "placed")
    giants = placed.where("root is not null").groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > together).select("root")
    alone = placed.where("root is null").select("block", "position", F.col("position").alias("kept_position"), F.lit(None).cast("string").alias("matched"))
    small = _folded(placed.where("root is not null").join(giants, "root", "left_anti"))
    return alone.unionByName(small).unionByName(_in_rounds(placed.join(giants, "root", "left_semi")))


def discovery(records: DataFrame, block: str, cap: int) -> DataFrame:
    """RET-13, WIN-06, SRT-06, JON-14: (block, position, candidate_id, duplicate, matched, within): each record with the id of the candidate that it is or repeats.

    Candidates are numbered by position within a block; ``within`` is false for those after the first ``cap``, which keep their ids. Repeats
    point to their candidate by its position, so candidates without an identifier aren't mixed up.
    """
    linked = dedup(records, block)
    number = F.row_number().over(Window.partitionBy("block").orderBy("position"))
    kept = linked.where("position = kept_position").select("block", "kept_position", number.alias("n"))
    made = linked.join(kept, ["block", "kept_position"])
    return made.select("block", "position", F.format_string("D%02d", "n").alias("candidate_id"), (F.col("position") != F.col("kept_position")).alias("duplicate"), "matched", (F.col("n") <= cap).alias("within"))


def discovery_log(found: DataFrame) -> DataFrame:
    """SRT-06, RET-13: per block of ``discovery`` its records, those that repeat another, its candidates, and those dropped beyond the cap."""
    first = ~F.col("duplicate")
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return found.groupBy("block").agg(F.count("*").alias("records"), count(F.col("duplicate")).alias("duplicates"), count(first).alias("candidates"), count(first & ~F.col("within")).alias("dropped"))
