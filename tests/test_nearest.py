import duckdb
import numpy as np
import pytest

from tamiz.operators import nearest, retrieval
from tamiz.plans import catalogue

TABLES = ("documents", "benchmark")


@pytest.fixture(scope="module")
def wordless(spark, small, tmp_path_factory):
    """The small tables with documents that have no word of three letters, and none at all."""
    path = str(tmp_path_factory.mktemp("wordless"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(900001, "Re.", "en", "src3", 3), (900002, "", "fr", "src4", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def same_as_sql(spark, path, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, path)
    found = db.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    return sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in found.fetchall())


def test_rrf_fusion_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "rrf_fusion")


@pytest.mark.parametrize("undefined", [0.0, float("nan")])
@pytest.mark.parametrize("limit", [10, 60])
def test_nearest_equal_all_pairs(spark, monkeypatch, undefined, limit):
    for name, n in (("ROWS", 20), ("ASKED", 3), ("KEPT", 1)):
        monkeypatch.setattr(nearest, name, n)
    x = np.random.default_rng(1).integers(-2, 3, (300, 4)).astype(float)  # many ties
    x[[5, 77]] = 0
    vectors = spark.createDataFrame([(k, None if k == 9 else v) for k, v in enumerate(x.tolist())], "doc_id long, v array<double>")
    asked = [k for k in range(300) if k % 20 == 5] + [9]
    got = retrieval.dense(vectors, vectors.where(vectors.doc_id.isin(asked)).withColumnRenamed("doc_id", "query_id"), limit, undefined).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(a, b):
        return None if 9 in (a, b) else round(float(u[a] @ u[b]), 9) + 0.0 if x[a].any() and x[b].any() else undefined

    place = lambda s: 2.0 if s is None else -9.0 if s != s else -s
    want = [(a, k, b) for a in asked for k, (_, b) in enumerate(sorted((place(score(a, b)), b) for b in range(300))[:limit], 1)]
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == sorted(want)


def test_diversified_topk_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "diversified_topk")


def test_evaluation_summary_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "evaluation_summary")


def test_judgment_counts_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "judgment_counts")


def test_retrieval_pool_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "retrieval_pool")


def test_search_dense_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "search_dense")


def test_search_results_with_documents_without_words(spark, wordless):
    assert same_as_sql(spark, wordless, "search_results")


def test_nearest_leave_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 50)
    x = np.random.default_rng(2).normal(size=(2000, 6))
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "doc_id long, v array<double>").coalesce(1)
    queries = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    assert nearest.first(vectors, queries, 10).count() < 0.06 * 20 * 2000
    assert nearest.first(vectors, queries, 0 + 1, undefined=float("nan")).count() < 0.02 * 20 * 2000


def test_best_by_label_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 40)
    monkeypatch.setattr(nearest, "ASKED", 3)
    x = np.random.default_rng(4).integers(-2, 3, (200, 4)).astype(float)
    x[[5, 77]] = 0
    labels = [None if k % 11 == 0 else k % 3 for k in range(200)]
    data = [(k, v, labels[k]) for k, v in enumerate(x.tolist())]
    vectors = spark.createDataFrame(data, "doc_id long, v array<double>, label int")
    asked = [k for k in range(200) if k % 20 == 5]
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {}
    for a in asked:
        for b in range(200):
            if a != b and None not in (labels[a], labels[b]):
                key = (a, labels[a] == labels[b])
                want[key] = max(want.get(key, -9.0), round(float(u[a] @ u[b]), 9))
    got = nearest.best_by_label(vectors, vectors.where(vectors.doc_id.isin(asked)).withColumnRenamed("doc_id", "query_id")).collect()
    assert {(r.query_id, r.own): round(r.score, 9) for r in got} == want
