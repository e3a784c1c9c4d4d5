"""Exact nearest vectors by cosine, with groups of vectors left out by the triangle inequality (RET-03, JON-09).

On the unit sphere cosine orders like distance. Vectors are grouped under the nearest of some pivots, and a group knows how far its
farthest vector is from its pivot. A question is as far from any vector of a group as from the pivot, less that radius, at least. The
nearest groups give a first bar, the distance of the ``limit``-th vector found; then only groups that may hold something nearer are
looked at. Scores are products of whole blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import numbers
from tamiz.operators import retrieval
from tamiz.session import written

#: Pivots at most, vectors of a group that lie in one block, and what rounding may take from a bound.
PIVOTS, BLOCK, SLACK = 1024, 2048, 1e-6


def _rows(vectors) -> np.ndarray:
    return np.stack(vectors).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def build(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, groups) of (doc_id, v): blocks (part, group, doc_id, v) of unit vectors, and groups (group, parts, n, pivot, radius).

    About the square root of all vectors are pivots, ``PIVOTS`` at most: a bounded set, picked by hash, that all tasks get. All vectors
    are grouped; large groups are dealt into blocks.
    """
    spark = vectors.sparkSession
    units = written(vectors.select("doc_id", numbers.unit(F.col("v")).alias("v")), "units")
    n = units.count()
    chosen = units.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, min(PIVOTS, round(n**0.5)))).collect()
    pivots = _rows([r.v for r in chosen])

    @F.pandas_udf("struct<group int, far double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = _far(_rows(v), pivots)
        at = d.argmin(axis=1)
        return pd.DataFrame({"group": at.astype(np.int32), "far": d[np.arange(len(d)), at]})

    placed = written(units.withColumn("x", nearest("v")).select("doc_id", "v", "x.group", "x.far"), "placed")
    kept = spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(pivots)], "group int, pivot array<double>")
    groups = placed.groupBy("group").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / BLOCK)).join(kept, "group")
    blocks = placed.join(groups.select("group", "parts"), "group").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    return written(blocks.select("group", "part", "doc_id", "v"), "blocks"), written(groups, "groups")


def _scores(limit: int, kind: str):
    """Questions asked of a block -> the block's first ``limit`` of each, with the number looked at."""

    def scores(asked: pa.Table, block: pa.Table) -> pa.Table:
        q, x, ids = _rows(asked["v"].to_numpy()), _rows(block["v"].to_numpy()), block["doc_id"].to_numpy()
        if not len(q) or not len(x):
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "doc_id": block["doc_id"].slice(0, 0), "score": pa.array([], pa.float64()), "looked": pa.array([], pa.int64())})
        s = np.round(q @ x.T, retrieval.RANKED)
        picked = [np.lexsort((ids, -row))[:limit] for row in s]
        at = np.repeat(np.arange(len(q)), [len(p) for p in picked])
        flat = np.concatenate(picked)
        looked = np.concatenate([np.eye(1, len(p), dtype=np.int64)[0] * len(x) for p in picked])  # once for each question
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), "doc_id": pa.array(ids[flat]), "score": pa.array(s[at, flat]), "looked": pa.array(looked)})

    return scores


def _asked(blocks: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, looked) of pairs (query_id, v, group, parts)."""
    kinds = dict(pairs.dtypes) | dict(blocks.dtypes)
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("group").alias("g"), F.col("part").alias("p"), "query_id", "v")
    out = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, looked long"
    return each.groupBy("g", "p").cogroup(blocks.groupBy("group", "part")).applyInArrow(_scores(limit, out), out)


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nearest of (query_id, v) as ``retrieval.dense`` gives them, before rounding for show; and (query_id, looked, vectors): how many were looked at, of all.

    ``index`` is what ``build`` gives. The groups' pivots, ``PIVOTS`` at most, are collected; questions are dealt out.
    """
    blocks, groups = index
    told = groups.orderBy("group").collect()
    if not told:
        return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int"), queries.sparkSession.createDataFrame([], "query_id long, looked long, vectors long")
    pivots, radius, size = _rows([r.pivot for r in told]), np.array([r.radius for r in told]), np.array([r.n for r in told])
    names, total = np.array([r.group for r in told], np.int32), int(sum(r.n for r in told))

    @F.pandas_udf("array<int>")
    def first(v: pd.Series) -> pd.Series:
        d = _far(_rows(v), pivots)
        order = d.argsort(axis=1)
        enough = np.argmax(size[order].cumsum(axis=1) >= min(limit, total), axis=1) + 1
        return pd.Series([names[o[:e]].tolist() for o, e in zip(order, enough, strict=True)])

    @F.pandas_udf("array<int>")
    def within(v: pd.Series, bar: pd.Series, done: pd.Series) -> pd.Series:
        near = _far(_rows(v), pivots) - radius <= np.sqrt(np.maximum(2 - 2 * bar.to_numpy(), 0))[:, None] + SLACK
        return pd.Series([[g for g in names[row].tolist() if g not in set(x)] for row, x in zip(near, done, strict=True)])

    units = queries.select("query_id", numbers.unit(F.col("v")).alias("v"))
    begun = written(units.withColumn("groups", first("v")), "asked")
    parts = groups.select("group", "parts")
    spread = lambda df: df.select("query_id", "v", F.explode("groups").alias("group")).join(parts, "group")
    some = written(_asked(blocks, spread(begun), limit), "some")
    bars = retrieval.ranked(some, limit).groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n"))
    bar = F.when(F.col("n") >= limit, F.col("bar")).otherwise(-1.0)
    rest = begun.join(bars, "query_id").withColumn("groups", within("v", bar, "groups"))
    every = written(some.unionByName(_asked(blocks, spread(rest), limit)), "found")
    looked = every.groupBy("query_id").agg(F.sum("looked").alias("looked")).withColumn("vectors", F.lit(total))
    return retrieval.ranked(every.drop("looked"), limit), looked
