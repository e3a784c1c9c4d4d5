"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Each distinct vector is a node, which knows its ``degree`` nearest nodes found so far. First nodes are dealt several times into blocks of
bounded size, by the sides of random planes and once at random, and take their nearest of each block. Then come rounds: all nodes that
know a node or are known by it meet there, so that each meets its neighbours' neighbours, and every pair that has not met yet is measured.
A search starts at a few nodes and goes to the neighbours of the nearest nodes known, until those have all been asked.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, cut, discard, new_folder

GRAPH = "node long, ids array<long>, ds array<double>, fresh array<boolean>"
FOUND = "node long, ids array<long>, ds array<double>"


@dataclasses.dataclass
class Index:
    """nodes (node, vec), graph (``GRAPH``, nearest first), copies (node, vec_id) and the number of copies kept of a vector."""

    nodes: DataFrame
    graph: DataFrame
    copies: DataFrame
    kept: int


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(``key`` as long, vec) of the vectors that take part: not null, not zero, all components finite, of the commonest length (the longer of equals); ids that are null take no part."""
    v = F.col(column)
    fine = F.col(key).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(key).cast("long").alias(key), v.alias("vec"))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (size.n if size else 0))


def _matrix(codes: pa.Array) -> np.ndarray:
    """Vectors as rows, from their bytes."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return np.frombuffer(b"".join(codes.to_pylist()), np.float32).reshape(len(codes), -1).astype(np.float64)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a block; infinite to itself."""
    x = x - x.mean(axis=0)
    n = (x * x).sum(axis=1)
    out = np.maximum(n[:, None] + n[None] - 2 * (x @ x.T), 0)
    np.fill_diagonal(out, np.inf)
    return out


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each run of equal ``keys``; a run may reach over batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        columns = [t[k].to_numpy() for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([np.concatenate(([True], c[1:] != c[:-1])) for c in columns]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """(nodes, lengths of their lists, others, distances) as batches of ``FOUND``."""
    held, size = [], 0
    for one in found:
        held.append(one)
        size += len(one[0])
        if size >= rows:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    nodes, lengths, others, ds = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(nodes), _lists(lengths, pa.array(others)), _lists(lengths, pa.array(ds))], ["node", "ids", "ds"])


def _seeded(degree: int) -> Callable:
    """Blocks of (deal, key, part, node, code) -> the nearest ``degree`` of each block for each of its nodes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for run in _runs(batches, ["deal", "key", "part"]):
            if run.num_rows > 1:
                ids, d = run["node"].to_numpy(), _squares(_matrix(run["code"]))
                k = min(degree, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield ids, np.full(len(ids), k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()

    return lambda batches: _gathered(each(batches))


def _introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings of (centre, part, node, fresh, most, code) -> for each node those met for the first time that are nearer than ``most``, what its farthest neighbour has."""

    def each() -> Iterator[tuple]:
        for run in _runs(batches, ["centre", "part"]):
            fresh = run["fresh"].to_numpy()
            if not fresh.any():
                continue
            ids, first, where = np.unique(run["node"].to_numpy(), return_index=True, return_inverse=True)
            new = np.zeros(len(ids), bool)
            np.logical_or.at(new, where, fresh)
            d = _squares(_matrix(run["code"])[first])
            good = (d < run["most"].to_numpy()[first][:, None]) & (new[:, None] | new[None])
            lengths = good.sum(axis=1)
            some = lengths > 0
            if some.any():
                i, j = np.nonzero(good)
                yield ids[some], lengths[some], ids[j], d[i, j]

    return _gathered(each())


def _merged(degree: int) -> Callable:
    """Lists by node (``GRAPH``, sorted by node) -> one list for each node: its nearest ``degree``, each once. What is not fresh stays so."""

    def least(t: pa.Table) -> pa.Table:
        lists = t["ids"].combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        node = np.repeat(t["node"].to_numpy(), lengths)
        other, d, fresh = (pc.list_flatten(t[c].combine_chunks()).to_numpy(zero_copy_only=False) for c in ("ids", "ds", "fresh"))
        order = np.lexsort((d, fresh, other, node))
        node, other, d, fresh = node[order], other[order], d[order], fresh[order]
        once = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])))[: len(node)]
        node, other, d, fresh = node[once], other[once], d[once], fresh[once]
        order = np.lexsort((other, d, node))
        node, other, d, fresh = node[order], other[order], d[order], fresh[order]
        own, starts = np.unique(node, return_index=True)
        place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
        keep = place < degree
        counts = np.bincount(np.searchsorted(own, node[keep]), minlength=len(own))
        return pa.table([pa.array(own), *(_lists(counts, pa.array(x[keep])) for x in (other, d, fresh))], names=["node", "ids", "ds", "fresh"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = least(t if rest is None else pa.concat_tables([rest, t.cast(rest.schema)]))  # at most one list of a node is carried on
            if t.num_rows:
                yield from t.slice(0, t.num_rows - 1).to_batches()
                rest = t.slice(t.num_rows - 1)
        if rest is not None:
            yield from rest.combine_chunks().to_batches()

    return merge


def _graph(lists: DataFrame, degree: int) -> DataFrame:
    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(_merged(degree), GRAPH)


def _fresh(found: DataFrame) -> DataFrame:
    return found.withColumn("fresh", F.transform("ids", lambda x: F.lit(True)))


def _coded(middle: list[float], scale: float, planes: list[np.ndarray]) -> Callable:
    """(node, vec) -> with the vector less ``middle``, over ``scale``, as bytes, and its side of each of ``planes`` as one number a deal."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) - middle) / scale
            sides = [((x @ p) > 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)) for p in planes]
            codes = pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())
            keys = _lists(np.full(batch.num_rows, len(planes)), pa.array(np.stack(sides, axis=1).ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, keys], ["node", "vec", "code", "keys"])

    return code


def _seeds(nodes: DataFrame, block: int, n: int, degree: int) -> DataFrame:
    """``FOUND`` lists from blocks of at most about ``block`` nodes: those on the same sides of a deal's planes, large ones dealt out at random, and one deal wholly at random."""
    keys = F.posexplode(F.concat("keys", F.array(F.pmod(F.xxhash64("node"), F.lit(max(1, n // block)))))).alias("deal", "key")
    dealt = nodes.select("node", "code", keys)
    parts = dealt.groupBy("deal", "key").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = dealt.join(parts, ["deal", "key"]).withColumn("part", F.pmod(F.xxhash64("node", "deal"), F.col("parts")))
    by = ["deal", "key", "part"]
    return placed.select(*by, "node", "code").repartition(*by).sortWithinPartitions(*by).mapInArrow(_seeded(degree), FOUND)


def _round(nodes: DataFrame, graph: DataFrame, degree: int, together: int) -> DataFrame:
    """One round of meetings. Those that know a node are dealt into parts of about ``together``, each of which also meets all that the node knows."""
    edges = graph.select(F.col("node").alias("a"), F.explode(F.arrays_zip("ids", "fresh")).alias("x")).select("a", F.col("x.ids").alias("b"), F.col("x.fresh").alias("fresh"))
    crowds = edges.groupBy(F.col("b").alias("centre")).agg(F.ceil(F.count("*") / together).alias("parts")).where("parts > 1")
    forward = edges.select(F.col("a").alias("centre"), F.col("b").alias("node"), "fresh").join(crowds, "centre", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    backward = edges.select(F.col("b").alias("centre"), F.col("a").alias("node"), "fresh").join(crowds, "centre", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    most = F.when(F.size("ids") < degree, F.lit(math.inf)).otherwise(F.element_at("ds", -1))
    known = nodes.select("node", "code").join(graph.select("node", most.alias("most")), "node")
    by = ["centre", "part"]
    meetings = forward.drop("parts").unionByName(backward.drop("parts")).join(known, "node").select(*by, "node", "fresh", "most", "code")
    found = meetings.repartition(*by).sortWithinPartitions(*by).mapInArrow(_introduced, FOUND)
    old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
    return _graph(old.unionByName(_fresh(found)), degree)


def index(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", degree: int = 32, block: int = 512, deals: int = 4, together: int = 128, settled_at: float = 0.2, most_rounds: int = 12, kept: int = 11, seed: int = 7) -> Index:
    """The neighbour graph of all ``usable`` vectors.

    Equal vectors are one node; the ``kept`` smallest ids of a node are listed, which is all that the nearest
    ``kept`` - 1 rows of a query can hold. Rounds end when less than ``settled_at`` of the graph's entries is new, at the latest after
    ``most_rounds``. A group that meets in one place has at most about ``degree`` + ``together`` nodes, a block about ``block``, whatever
    the data. No vectors give an empty index.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = cut(usable(vectors, key, column).distinct().withColumn("_row", F.monotonically_increasing_id()), "vectors")
    by = Window.partitionBy("vec").orderBy(key)
    listed = rows.select(F.col(key).alias("vec_id"), "vec", F.row_number().over(by).alias("place"), F.first("_row").over(by).alias("node")).where(F.col("place") <= kept)
    copies = cut(listed, "copies")
    own = copies.where("place = 1").select("node", "vec")
    n = own.count()
    width = own.select(F.size("vec").alias("n")).first()
    width = width.n if width else 0
    sums = own.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.max(F.abs("x")).alias("top")).orderBy("i").collect()  # a row for each component
    r, bits = np.random.default_rng(seed), max(0, math.ceil(math.log2(max(n, 1) / block)))
    planes = [r.normal(size=(width, bits)) for _ in range(deals if bits else 1)]
    kind = dict(own.dtypes)["vec"]
    coded = own.mapInArrow(_coded([x.m for x in sums], max([x.top for x in sums], default=1.0), planes), f"node long, vec {kind}, code binary, keys array<long>")
    nodes = cut(coded, "nodes")
    graph, path = _written(_graph(_fresh(_seeds(nodes, block, n, degree)), degree), "graph")
    for _ in range(most_rounds):
        before = path
        graph, path = _written(_round(nodes, graph, degree, together), "graph")
        discard(spark, before)
        new = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        if not new["all"] or new["new"] < settled_at * new["all"]:
            break
    return Index(nodes.select("node", "vec"), graph, copies.select("node", "vec_id"), kept)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _measured() -> Column:
    return F.struct(distance(F.col("qv"), F.col("vec")).alias("d"), F.col("node").alias("id")).alias("x")


def search(found: Index, queries: DataFrame, k: int = 10, beam: int = 192, starts: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each of ``queries`` (query_id, vec), nearest first, ties to smaller vec_id; rows with the query's own id are left out.

    A search starts at ``starts`` nodes, the same for all queries, and at the node that equals the query, if there is one. It keeps the
    ``beam`` nearest nodes that it has met, and each round asks those that were not asked yet for their neighbours. Equal queries are
    searched once. All nodes of a query that were met lie in one row, some thousands of numbers. Null, zero or otherwise unusable queries
    have no rows.
    """
    if k >= found.kept:
        raise ValueError(f"the index lists {found.kept} copies of a vector: k must be less")
    spark, nodes = queries.sparkSession, found.nodes
    asked = usable(queries, "query_id", "vec").distinct()
    alike = cut(asked.groupBy("vec").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("q"), "vec"), "queries")
    named = asked.join(alike, "vec").select("query_id", "q")
    first = [r.node for r in nodes.select("node").orderBy(F.xxhash64("node")).limit(starts).collect()]
    own = alike.join(nodes, "vec")
    each = alike.select("q", F.col("vec").alias("qv"), F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")).alias("node"))
    begun = each.join(F.broadcast(nodes.where(F.col("node").isin(first))), "node").select("q", _measured())  # ``starts`` rows
    begun = begun.unionByName(own.select("q", F.struct(F.lit(0.0).alias("d"), F.col("node").alias("id")).alias("x"))).distinct()
    empty = alike.select("q", F.col("vec").alias("qv"), F.array().cast("array<struct<d:double,id:bigint>>").alias("near"), F.array().cast("array<bigint>").alias("seen"))
    state, path = _written(_met(empty, begun, beam), "search")
    while not state.where(F.size("todo") > 0).isEmpty():
        before = path
        state, path = _written(_advanced(found, state, beam), "search")
        discard(spark, before)
    best = state.select("q", F.explode("near").alias("x")).select("q", F.col("x.d").alias("score"), F.col("x.id").alias("node"))
    rows = best.join(found.copies, "node").join(named, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(state: DataFrame, measured: DataFrame, beam: int) -> DataFrame:
    """``state`` (q, qv, near, seen) after nodes were ``measured`` (q, x of d and id), each once: the nearest stay, those that are new among them are to be asked."""
    grouped = measured.groupBy("q").agg(F.collect_list("x").alias("new"))
    both = state.select("q", "qv", "near", "seen").join(grouped, "q", "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<d:double,id:bigint>>")))
    near = both.withColumn("near", F.slice(F.array_sort(F.concat("near", "new")), 1, beam))
    return near.select("q", "qv", "near", F.concat("seen", "new.id").alias("seen"), F.array_intersect("near.id", "new.id").alias("todo"))


def _advanced(found: Index, state: DataFrame, beam: int) -> DataFrame:
    """One round of all searches."""
    frontier = state.select("q", F.explode("todo").alias("node"))
    told = frontier.join(found.graph.select("node", "ids"), "node").groupBy("q").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    fresh = told.join(state.select("q", "qv", "seen"), "q").select("q", "qv", F.explode(F.array_except("ids", "seen")).alias("node"))
    return _met(state, fresh.join(found.nodes, "node").select("q", _measured()), beam)
