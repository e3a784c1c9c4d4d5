"""Neighbours against brute force: recall, distances, ties, copies, crowded nodes and unusable vectors."""

import numpy as np
import pytest

from tamiz.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q, v in asked:
        d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    """Distances are exact and lists in order; the share of the true neighbours found."""
    for q, found in got.items():
        assert [(s, i) for i, s in found] == sorted((s, i) for i, s in found) and len(found) == len(want[q])
        truth = dict(want[q])
        assert all(abs(truth[i] - s) < 1e-12 for i, s in found if i in truth)
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_embeddings(spark, small, size):
    sf = small.replace("sf0.001", size)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [x for x in rows if x[0] % 100 == 0])
    got = told(queries.op11_neighbours(spark, sf))
    assert got.keys() == want.keys() and recall(got, want) >= 0.97


def test_clusters_copies_and_crowds(spark):
    """Far clusters, a third of all rows one vector, a tight swarm, one vector of huge length; small blocks, so that the graph comes from meetings."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(900, 8)) * 0.3 + 5 * c for c in r.normal(size=(4, 8))] + [1000 + 1e-3 * r.normal(size=(300, 8)), [[1e6] * 8]])
    rows = [(7 * k, v) for k, v in enumerate(x.astype(np.float32).tolist())] + [(7 * k + 1, x[5].astype(np.float32).tolist()) for k in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    own = [v for i, v in rows if i == 35][0]
    asked = [row for row in rows if row[0] % 50 == 0] + [(-1, [0.5] * 8), (-2, own), (-3, rows[3700][1])]
    q = spark.createDataFrame(asked, "query_id long, vec array<float>")
    index = neighbours.index(df, degree=16, block=64, together=8)
    assert index.nodes.count() == 3901 and index.graph.count() == 3901
    got = told(neighbours.search(index, q, beam=48))
    want = brute(rows, asked)
    assert got.keys() == want.keys() and recall(got, want) >= 0.97
    assert [i for i, _ in got[-2]] == [i for i, _ in want[-2]] and got[-2][0] == (1, 0.0)  # ties to smaller ids


def test_odd_vectors(spark):
    """Null, zero, short and non-finite vectors and null ids take no part, repeated rows count once, two rows may share an id, and there may be fewer candidates than asked."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0]), (3, [5.0, 5.0]), (11, [-0.0, 2.0])]
    df = spark.createDataFrame([(*x, 0, "n") for x in rows], f"{SCHEMA}, node int, vec string")
    index = neighbours.index(df)
    asked = df.selectExpr("vec_id as query_id", "embedding as vec", "node as rank")
    got = told(neighbours.search(index, asked))
    assert got.keys() == {1, 2, 3, 11}
    assert got[1] == [(2, 0.0), (3, 5**0.5), (11, 5**0.5)] and [i for i, _ in got[11]] == [3, 1, 2]
    assert got[3] == [(11, 0.0), (1, 5**0.5), (2, 5**0.5)]
    nothing = df.limit(0)
    assert neighbours.search(neighbours.index(nothing), asked.limit(0)).count() == 0
    assert neighbours.search(index, asked.limit(0)).count() == 0 and neighbours.search(neighbours.index(nothing), asked).count() == 0
    one = neighbours.index(df.where("vec_id = 2"))
    assert neighbours.search(one, asked.where("query_id = 2")).count() == 0
    with pytest.raises(ValueError):
        neighbours.search(index, asked, k=11)
