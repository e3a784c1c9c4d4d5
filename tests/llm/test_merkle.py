"""The manifest against a plain tree, its layout, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tamiz.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def tree(leaves):
    """All levels, from the leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, k):
    for level in levels[:-1]:
        run = level[k // 2 * 2 : k // 2 * 2 + 2]
        yield k % 2, [x for j, x in enumerate(run) if j != k % 2]
        k //= 2


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[n] = tree([leaf(r) for r in groups[n]])
    top, out = tree([trees[n][-1][0] for n in names]), []
    for i, n in enumerate(names):
        for k, r in enumerate(groups[n]):
            path = [*way(trees[n], k), *way(top, i)]
            spoilt = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                spoilt["n_chars"] += 1
            at = leaf(spoilt)
            for odd, others in path:
                at = sha(*others, at) if odd else sha(at, *others)
            out.append((r["doc_id"], leaf(r), trees[n][-1][0], top[-1][0], sha(*[x for _, o in path for x in o]), at, at == top[-1][0]))
    return sorted(map(str, out))


def told(df):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in df.collect())


def test_manifest_of_documents_equals_a_plain_tree(spark, small):
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert told(queries.op13_merkle(spark, small)) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 17, 81])
def test_subtrees_of_every_size(spark, n):
    """Subtrees of four leaves, so that up to four of them stand above one another, in groups of very different sizes."""
    rows = [{"doc_id": (k * 31) % 1000, "source": "s", "lang": None if k % 11 == 5 else f"l{k % 13}" if k % 3 == 0 else "hot", "n_chars": k, "text": "é" * (k % 5)} for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(merkle.manifest(df, COLUMNS, claimed=merkle.spoilt(COLUMNS), height=2)) == expected(rows)


def test_layout_is_van_emde_boas():
    order = lambda levels: sorted(((d, i) for d in range(levels) for i in range(1 << d)), key=lambda x: merkle.address(*x, levels))
    assert order(4) == [(0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (2, 1), (3, 2), (3, 3), (2, 2), (3, 4), (3, 5), (2, 3), (3, 6), (3, 7)]
    for levels in range(1, 12):
        assert sorted(merkle.address(d, i, levels) for d in range(levels) for i in range(1 << d)) == list(range((1 << levels) - 1))
    tree_, root = merkle.lay_out([sha(str(k)) for k in range(5)], 3)
    assert merkle.fold(sha("4"), merkle.steps(tree_, 5, 3, 4)) == root and merkle.steps(tree_, 5, 3, 4)[:2] == ["N", "N"]


def test_odd_rows(odd):
    """Null ids and columns, empty and long texts, repeated rows, clashing names: a leaf each; an empty table has none."""
    df = odd.withColumn("n_chars", F.when(F.col("doc_id") != 5, F.length("text").cast("long"))).withColumns({"group": F.lit("x"), "position": F.lit(7), "digest": F.lit("y"), "path": F.lit(1)})
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [r.asDict() for r in df.collect()]
    assert told(merkle.manifest(df, COLUMNS, claimed=merkle.spoilt(COLUMNS))) == expected(rows)
    assert merkle.manifest(df.limit(0), COLUMNS).count() == 0
    paths = merkle.manifest(df, COLUMNS, with_path=True).collect()
    assert all(merkle.fold(r.leaf, r.path) == r.root and r.verified for r in paths)
