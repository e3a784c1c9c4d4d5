"""Exact nearest vectors of a stated query set by products of blocks (RET-03, RET-08).

Vectors and questions are packed into rows of a block each, and each pair of blocks is one matrix product. Of its scores only those leave a
task that can still be among the first: a question's bar is the worst of the best ones that its task has seen. A task holds the blocks of
one Arrow batch and the bars of a bounded number of blocks of questions.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.session import written

#: Vectors and questions of a block, and blocks of questions whose bars a task keeps.
ROWS, ASKED, KEPT = 2048, 1024, 64
#: A vector's state: it has a direction, none, or is null or holds a null.
GIVEN, ZERO, MISSING = 0, 1, 2


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """(id, v, label) -> blocks (ids, labels, states, size, units) of vectors of one size, scaled to length 1."""
    kinds = dict(df.dtypes)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = pa.Table.from_batches([batch.slice(at, rows)]).combine_chunks()
                sizes = pc.fill_null(pc.list_value_length(part["v"]), -1).to_numpy()
                for size in np.unique(sizes):
                    own = part.filter(pa.array(sizes == size)).combine_chunks()
                    width, n = max(int(size), 0), own.num_rows
                    held = pc.list_flatten(own["v"]).cast(pa.float64())
                    x = pc.fill_null(held, 0).to_numpy().reshape(n, width) if width else np.zeros((n, 0))
                    lacks = held.is_null().to_numpy().reshape(n, width).any(axis=1) if width else np.full(n, size < 0)
                    with np.errstate(over="ignore", invalid="ignore"):
                        far = np.sqrt((x * x).sum(axis=1))
                        x = x / np.maximum(far, 1e-12)[:, None]
                    states = np.where(lacks, MISSING, np.where(far == 0, ZERO, GIVEN)).astype(np.int8)
                    lists = [pa.ListArray.from_arrays([0, n], pa.concat_arrays(own[c].chunks)) for c in ("id", "label")]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([states.tobytes()]), pa.array([width], pa.int32()), pa.array([x.tobytes()])], ["ids", "labels", "states", "size", "units"])

    return df.select("id", "v", "label").mapInArrow(pack, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, states binary, size int, units binary")


def _blocks(batch: pa.RecordBatch, name: str, k: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    of = lambda c: batch.column(batch.schema.get_field_index(f"{name}_{c}"))[k]
    ids, size = of("ids").values, of("size").as_py()
    return ids, of("labels").values, np.frombuffer(of("states").as_py(), np.int8), np.frombuffer(of("units").as_py(), np.float64).reshape(len(ids), size)


def _scores(asked: tuple, held: tuple, digits: int, undefined: float) -> np.ndarray:
    """The block of cosines: infinity for NaN, which goes before all numbers, less than any number for null."""
    (_, _, a, q), (_, _, b, x) = asked, held
    if q.shape[1] != x.shape[1]:
        return np.full((len(q), len(x)), -np.inf)
    with np.errstate(invalid="ignore"):
        s = np.rint(q @ x.T * 10.0**digits) / 10.0**digits
    s[(a == ZERO)[:, None] | (b == ZERO)] = undefined
    s[np.isnan(s)] = np.inf
    s[(a == MISSING)[:, None] | (b == MISSING)] = -np.inf
    return s


def _told(s: np.ndarray) -> pa.Array:
    return pa.array(np.where(s == np.inf, np.nan, s), pa.float64(), mask=s == -np.inf, from_pandas=False)


def _codes(values: pa.Array) -> np.ndarray:
    """Whole numbers that are equal where values are, nulls too, and in their order."""
    x = values.to_numpy(zero_copy_only=False)
    if x.dtype == object:
        x = np.array(["" if v is None else f" {v}" for v in x])
    return np.unique(x, return_inverse=True)[1]


def _group_floors(s: np.ndarray, labels: np.ndarray, most: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Per question and vector the ``most``-th best score of the vector's label, and per question a score that ``limit`` labels reach."""
    order = np.argsort(labels, kind="stable")
    starts = np.flatnonzero(np.diff(labels[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    floors, best = np.full(s.shape, -np.inf), np.maximum.reduceat(s[:, order], starts, axis=1)
    for a, b in zip(starts, ends, strict=True):
        if b - a > most:
            own = order[a:b]
            floors[:, own] = np.partition(s[:, own], b - a - most, axis=1)[:, [b - a - most]]
    bar = np.partition(best, best.shape[1] - limit, axis=1)[:, best.shape[1] - limit] if best.shape[1] >= limit else np.full(len(s), -np.inf)
    return floors, bar


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal keys."""
    at = np.arange(len(sorted_keys))
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(at) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


def taken(s: np.ndarray, ids: pa.Array, labels: pa.Array | None, limit: int, most: int | None, bar: np.ndarray, top: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(question, vector) numbers of the block's first ``limit`` of each question at or above its ``bar``, the bars after that, and each question's best scores."""
    if most is None:
        some = s >= bar[:, None]
        if s.shape[1] > limit and some.sum() > 4 * limit * len(s):
            some = s >= np.maximum(bar, np.partition(s, s.shape[1] - limit, axis=1)[:, s.shape[1] - limit])[:, None]
    else:
        groups = _codes(labels)
        floors, reached = _group_floors(s, groups, most, limit)
        bar = np.maximum(bar, reached)
        some = (s >= bar[:, None]) & (s >= floors)
    q, x = np.nonzero(some)
    order = np.lexsort((_codes(ids)[x], -s[q, x], q))
    q, x = q[order], x[order]
    if most is not None:
        order = np.lexsort((np.arange(len(q)), groups[x], q))
        own = np.zeros(len(q), np.int64)
        own[order] = _places(q[order] * len(ids) + groups[x][order])
        q, x = q[own < most], x[own < most]
    place = _places(q)
    q, x, place = q[place < limit], x[place < limit], place[place < limit]
    if most is None:
        new = np.full((len(s), limit), -np.inf)
        new[q, place] = s[q, x]
        top = new if top is None else np.partition(np.concatenate([top, new], axis=1), limit, axis=1)[:, limit:]
        bar = top.min(axis=1)
    return q, x, bar, top


def _met(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of blocks of (id, v, label); the questions' blocks are written, so Spark knows their size and sends them to all tasks while that is small."""
    parts = -(-queries.count() // ASKED) or 1
    asked = written(_packed(queries.repartition(parts), ASKED).withColumn("block", F.monotonically_increasing_id()), "asked")
    named = lambda df, name: df.select([F.col(c).alias(f"{name}_{c}") for c in df.columns])
    return named(_packed(vectors, ROWS), "v").crossJoin(named(asked, "q"))


def first(vectors: DataFrame, queries: DataFrame, limit: int, label: str | None = None, most: int | None = None, undefined: float = 0.0, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, [label,] score): pairs of (query_id, v) and (doc_id, v, [label]) that hold each question's first ``limit`` by cosine, at most ``most`` of a label, ties by doc_id.

    Scores have ``digits``, so that those of equal vectors are equal. ``undefined`` is the score of vectors without a direction: 0, or NaN,
    which goes before all numbers. Nulls have null, which goes last.
    """
    of = F.lit(0) if label is None else F.col(label)
    held = vectors.select(F.col("doc_id").alias("id"), "v", of.alias("label"))
    asked = queries.select(F.col("query_id").alias("id"), "v", F.lit(0).alias("label"))

    def kernel(batches):
        tops: OrderedDict = OrderedDict()
        for batch in batches:
            for k in range(batch.num_rows):
                q, x, block = _blocks(batch, "q", k), _blocks(batch, "v", k), batch["q_block"][k].as_py()
                bar, top = tops.pop(block, (np.full(len(q[0]), -np.inf), None))
                s = _scores(q, x, digits, undefined)
                i, j, bar, top = taken(s, x[0], x[1], limit, most, bar, top)
                tops[block] = bar, top
                if len(tops) > KEPT:
                    tops.popitem(last=False)
                yield pa.RecordBatch.from_arrays([q[0].take(pa.array(i)), x[0].take(pa.array(j)), x[1].take(pa.array(j)), _told(s[i, j])], ["query_id", "doc_id", "label", "score"])

    kinds = {c: dict(df.dtypes) for c, df in (("v", held), ("q", asked))}
    found = _met(held, asked).mapInArrow(kernel, f"query_id {kinds['q']['id']}, doc_id {kinds['v']['id']}, label {kinds['v']['label']}, score double")
    return found.drop("label") if label is None else found.withColumnRenamed("label", label)


def best_by_label(vectors: DataFrame, queries: DataFrame, undefined: float = 0.0, digits: int = 9) -> DataFrame:
    """(query_id, own, score): the best score of each question (query_id, v, label) among vectors (doc_id, v, label) of its label, and among those of others; its own row and null labels don't count."""
    held = vectors.select(F.col("doc_id").alias("id"), "v", "label")
    asked = queries.select(F.col("query_id").alias("id"), "v", "label")

    def kernel(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                q, x = _blocks(batch, "q", k), _blocks(batch, "v", k)
                s = _scores(q, x, digits, undefined)
                joint = lambda c: np.split(_codes(pa.concat_arrays([q[c], x[c]])), [len(q[0])])  # noqa: B023, E731
                (a, b), (m, n) = joint(0), joint(1)
                s[a[:, None] == b] = -np.inf
                same = m[:, None] == n
                known = lambda c: c.is_valid().to_numpy(zero_copy_only=False)
                s[~known(q[1])] = -np.inf
                s[:, ~known(x[1])] = -np.inf
                for own in (True, False):
                    best = np.where(same == own, s, -np.inf).max(axis=1, initial=-np.inf)
                    at = np.flatnonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([q[0].take(pa.array(at)), pa.array(np.full(len(at), own)), _told(best[at])], ["query_id", "own", "score"])

    pairs = _met(held, asked).mapInArrow(kernel, f"query_id {dict(asked.dtypes)['id']}, own boolean, score double")
    return pairs.groupBy("query_id", "own").agg(F.max("score").alias("score"))
