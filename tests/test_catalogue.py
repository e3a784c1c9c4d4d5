import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tamiz.functions import numbers, text
from tamiz.operators import audit, linkage, retrieval
from tamiz.plans import catalogue, forms  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    found = db.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_golden_values(spark):
    lit = F.lit
    assert one(spark, text.match_expression(lit('empleo "formal" Perú'))) == '"empleo" OR "formal" OR "perú"'
    assert one(spark, text.normalize(lit("a\x00b  forma-\n ción x"))) == "a b formación x"
    assert one(spark, text.doi(lit("https://doi.org/10.1/ABC"))) == "10.1/abc"
    assert one(spark, text.citations(lit("x [2] y [10][2]"))) == [2, 10, 2]
    assert one(spark, text.page_range(lit(3), lit(5))) == "pp. 3–5"
    assert one(spark, text.is_grounded(lit("a  b …"), lit("x a b c"))) is True


@pytest.mark.parametrize(("chars", "words", "glued"), [(2248, 3, True), (4000, 40, False), (4000, 39, True), (250, 10, False), (260, 10, True), (179, 0, False)])
def test_glued(spark, chars, words, glued):
    assert one(spark, numbers.is_glued(F.lit(chars), F.lit(words))) is glued


def test_chunk_spans_golden(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * n)) for k, n in enumerate((120, 45, 20))], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in retrieval.chunk_spans(docs, 60, 10).collect())
    assert got == [(0, 0, 60), (0, 50, 110), (1, 0, 45)]


def test_diversity_and_metrics_golden(spark):
    results = spark.createDataFrame([(1, d, k) for k, d in enumerate("aaab", 1)], "query_id int, doc string, rank int")
    assert sorted(r["rank"] for r in retrieval.diversify(results, "doc", 4, 2).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        retrieval.diversify(results, "doc", 0, 2)
    ranges = spark.createDataFrame([(1, 7, 10, 12, 1), (1, 7, 20, 22, 1), (1, 7, 10, 12, 0)], "query_id int, document_id long, page_start int, page_end int, relevance int")
    got = spark.createDataFrame([(1, 7, 1, 2, 1), (1, 7, 11, 11, 2), (1, 7, 12, 13, 3), (1, 7, 21, 25, 4)], "query_id int, document_id long, page_start int, page_end int, rank int")
    r = retrieval.metrics(got, ranges).first()
    import math

    assert (r.hit_at_3, r.mrr) == (1, 0.5)
    assert r.ndcg_at_5 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), abs=1e-6)


def test_dedup_keeps_first_of_each_identifier(spark):
    rows = [("b", i, f"10.1/{i % 3}", "", f"t{i}") for i in range(9)] + [("c", 0, "10.1/a", "", ""), ("c", 1, "10.1/a", "W9", ""), ("c", 2, "", "W9", "")]
    df = spark.createDataFrame(rows, "block string, position long, doi string, id string, title string")
    got = {(r.block, r.position): r.kept_position for r in linkage.dedup(df, "block").collect()}
    assert all(got["b", i] == i % 3 for i in range(9))
    assert (got["c", 1], got["c", 2]) == (0, 2)  # a dropped record's other identifiers aren't remembered


def test_indicator_refuses_a_repeated_key(spark):
    left, right = spark.range(3), spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(ValueError):
        audit.with_indicator(left, right, ["id"])


def test_dedup_equals_a_fold_in_order(spark):
    import random

    r = random.Random(6)
    rows = [(b, i, r.choice(["", f"10.1/{r.randint(0, 40)}"]), r.choice(["", f"W{r.randint(0, 40)}"]), r.choice(["", f"t{r.randint(0, 9)}"])) for b in "ab" for i in range(200)]
    got = {(x.block, x.position): (x.kept_position, x.matched) for x in linkage.dedup(spark.createDataFrame(rows, "block string, position long, doi string, id string, title string"), "block").collect()}
    seen = {}
    for b, i, d, w, t in rows:
        keys = [f"doi:{d}"] * bool(d) + [f"id:{w.lower()}"] * bool(w) or [f"title:{t}"] * bool(t)
        hit = next((k for k in keys if (b, k) in seen), None)
        if hit is None:
            seen |= {(b, k): i for k in keys}
        assert got[b, i] == (i if hit is None else seen[b, hit], hit)


def test_writers_and_checks(spark, tmp_path):
    from tamiz.operators import governance
    from tamiz.sources import files

    df = spark.createDataFrame([("a", 'x "y"\nz', None)], "id string, note string, more string")
    files.rewrite_csv(df, str(tmp_path / "c"), ["note", "id"], ("more", "absent"))
    back = files.read_csv(spark, str(tmp_path / "c"), ("id",))
    assert back.columns == ["note", "id", "more"] and tuple(back.first()) == ('x "y"\nz', "a", "")
    for k in "ab":
        files.append_trace(spark.createDataFrame([(k, 1)], "step string, n int"), str(tmp_path / "t"), ["step", "n"])
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "t")).collect()) == [("a", "1"), ("b", "1")]
    (tmp_path / "s.json").write_text('{\n "strategy_id": "S",\n "limits": {"per_page": 5}\n}')
    schema = "strategy_id string, limits struct<per_page:int>, consultas array<string>"
    assert files.read_json(spark, str(tmp_path / "s.json"), schema, ("strategy_id", "limits")).first().limits.per_page == 5
    with pytest.raises(ValueError, match="consultas"):
        files.read_json(spark, str(tmp_path / "s.json"), schema, ("consultas",))
    assert files.without_text(df.withColumnRenamed("note", "text")).columns == ["id", "more"]
    assert governance.assembly_problems(True, "a", "b", 1) == ["written while a decision is open", "differs from the ledger"] and not governance.assembly_problems(False, "", "b", 1)
    pages = spark.createDataFrame([("d", 1, "ocr"), ("d", 2, None), ("d", 3, "x")], "document_id string, page int, source string")
    assert sorted(r.page for r in governance.ledger_sources(pages).collect()) == [2, 3]


def test_chunk_ids_follow_the_manifest(spark):
    from tamiz.operators import search

    chunks = spark.createDataFrame([(d, k) for d, n in (("x", 3), ("y", 1), ("z", 2)) for k in range(n)], "document_id string, ordinal int")
    manifest = spark.createDataFrame([("z", 0), ("x", 1001), ("y", 7)], "document_id string, position int")
    got = {(r.document_id, r.ordinal): r.chunk_id for r in search.chunk_ids(chunks, manifest).collect()}
    assert got == {("z", 0): 0, ("z", 1): 1, ("y", 0): 2, ("x", 0): 3, ("x", 1): 4, ("x", 2): 5}
    with pytest.raises(ValueError):
        search.search({}, manifest, "other")


def test_running_sums_and_headings_equal_plain_windows(spark):
    """One user has most rows, steps are small; null users are a group, null kinds are skipped, a null time comes first."""
    rows = [(k, None if k % 17 == 0 else 0 if k % 3 else k % 5, None if k == 40 else (k * 7919) % 500, None if k % 11 == 0 else "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, user long, at long, kind string")
    w = Window.partitionBy("user").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumns({"n_calls": F.count("*").over(w), "n_a": F.sum((F.col("kind") == "a").cast("int")).over(w)})
    got = audit.budget(df, "user", F.floor(F.col("at") / 20), ["at", "id"], F.col("kind"), {"a": 3}, 6)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    lines = df.where("at is not null").dropDuplicates(["user", "at"])
    heading = F.when(F.col("id") % 13 == 0, F.col("kind"))
    filled = audit.forward_fill(lines, "user", "at", heading, "section", 20).select("id", "section")
    by = Window.partitionBy("user").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert sorted(map(str, filled.collect())) == sorted(map(str, lines.select("id", F.last(heading, ignorenulls=True).over(by).alias("section")).collect()))
    spoken = audit.timeline(lines, "user", "at", F.col("id") / 10, 0.4, 20).select("id", "start_s", "end_s")
    end = F.sum(F.col("id") / 10).over(by) + 0.4 * (F.row_number().over(Window.partitionBy("user").orderBy("at")) - 1)
    assert sorted(map(str, spoken.collect())) == sorted(map(str, lines.select("id", F.round(end - F.col("id") / 10, 6).alias("start_s"), F.round(end, 6).alias("end_s")).collect()))


@pytest.mark.parametrize(("values", "median"), [([5.0], 5.0), ([1.0, 2.0], 2.0), ([3.0, 1.0, 2.0], 2.0), ([1.0, 1.0, 2.0, 9.0], 2.0), ([None, 4.0], 4.0), ([None], None)])
def test_upper_median(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.agg(audit.upper_median("x").alias("m")).first().m == median
