"""Indexes, sessions, linkage, path repair, line numbers and gates against plain versions of themselves."""

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.operators import gates, governance, impact, linkage, preflight, pruned, reports, retrieval, search, sessions
from tamiz.sources import files, scans


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def corpus(spark, n=400):
    r = random.Random(4)
    said = [" ".join(["the"] * r.randint(1, 9) + [f"word{min(r.randint(0, 60), r.randint(0, 60))}" for _ in range(r.randint(0, 30))] + [f"rare{k // 7}"]) for k in range(n)]
    return spark.createDataFrame([*enumerate(said), (n, ""), (n + 1, None)], "doc_id long, text string")


def test_impact_search_equals_full_scores_and_reads_less(spark, monkeypatch):
    monkeypatch.setattr(impact, "BLOCK", 8)
    docs = corpus(spark, 2000)
    asked = [(1, "word1 word3 rare3"), (2, "word1 word2 word3 the"), (3, "absent"), (4, "the"), (5, "rare0 rare1 rare2 word5"), (6, ""), (7, None)]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    index = impact.build(docs)
    got, report = impact.search(index, queries, 10)
    want = retrieval.bm25(docs, queries, 10)
    assert rows(retrieval.shown(got), "query_id", "rank", "doc_id", "score") == rows(want, "query_id", "rank", "doc_id", "score")
    read = {r.query_id: r.read / r.postings for r in report.collect()}
    assert read.keys() == {2, 4, 5, 1}
    few, report = impact.search(index, queries.where("query_id = 1"), 3)
    assert rows(retrieval.shown(few), "rank", "doc_id") == rows(want.where("query_id = 1 and rank <= 3"), "rank", "doc_id")
    assert report.select(F.col("read") / F.col("postings")).first()[0] < 0.5
    assert index["blocks"].agg(F.max("n")).first()[0] < 8 * 8  # blocks are of bounded size, also of a term that all have


def test_pruned_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK", 50)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(150, 8)) * 0.05 + c for c in r.normal(size=(8, 8))])
    data = [(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(5000 + k, [float(y) for y in x[3]]) for k in range(200)] + [(9000, [0.0] * 8)]
    vectors = spark.createDataFrame(data, "doc_id long, v array<double>")
    queries = vectors.where("doc_id % 90 = 3 or doc_id = 9000").withColumnRenamed("doc_id", "query_id")
    found, looked = pruned.search(pruned.build(vectors), queries)
    near = lambda df: [(q, k, d, round(s, 6)) for q, k, d, s in rows(df, "query_id", "rank", "doc_id", "score")]
    q = queries.select("query_id", F.col("v"))
    assert near(found) == near(retrieval.ranked(retrieval.dense_scores(vectors, q, 8), 10))
    report = looked.where("query_id <> 9000").agg(F.sum("looked") / F.sum("vectors"), F.max("looked")).first()
    assert report[0] < 0.5 and report[1] <= 1401
    few = vectors.where("doc_id < 4")
    assert pruned.search(pruned.build(few), q)[0].groupBy("query_id").count().agg(F.min("count"), F.max("count")).first() == (4, 4)
    assert pruned.search(pruned.build(vectors.limit(0)), q)[0].count() == 0


def chunks(spark):
    r = random.Random(2)
    made = [(k, f"d{k % 5}", "T", "A", "2020", "c", k, k, k + 1, "p.pdf", k, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(12))) for k in range(60)]
    kinds = {"chunk_id": "long", "page": "int", "page_start": "int", "page_end": "int", "ordinal": "int"}
    return spark.createDataFrame(made, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in ("chunk_id", *search.CHUNK_FIELDS, "text")))


def test_search_modes_hold_their_own_lists(spark, tmp_path):
    scans.write_index(search.build(chunks(spark)), str(tmp_path / "i"))
    index = {name: scans.read_index(spark, str(tmp_path / "i"), name) for name in search.TABLES}
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "zeta")], "query_id int, text string")
    found = {m: search.search(index, queries, m, 6, 2).collect() for m in search.MODES}
    assert all(r.lexical_score == 0 and r.score == r.dense_score for r in found["dense"]) and len(found["dense"]) == 12
    assert all(r.dense_score == 0 and r.score == r.lexical_score for r in found["lexical"]) and {r.query_id for r in found["lexical"]} == {1}
    assert all(r.dense_score for r in found["hybrid"] if r.query_id == 1) and any(r.lexical_score for r in found["hybrid"])
    for m in search.MODES:
        seen = {}
        for r in found[m]:
            seen.setdefault((r.query_id, r.document_id), []).append(r.chunk_id)
        assert max(map(len, seen.values())) <= 2
    assert {(r.mode, r.query_id) for r in search.search_all(index, queries).collect()} == {("lexical", 1), ("dense", 1), ("dense", 2), ("hybrid", 1), ("hybrid", 2)}
    # past the lexical list's end a score is not known
    shallow = search.search(index, queries.where("query_id = 1"), "hybrid", 60, 60, depth=3).collect()
    assert sum(r.lexical_score > 0 for r in shallow) == 3 < len(shallow)
    with pytest.raises(ValueError):
        search.search(index, queries, "hybrid", 0)
    spark.range(1).select(F.lit(1).alias("schema_version")).write.mode("overwrite").parquet(str(tmp_path / "i" / "index_config"))
    with pytest.raises(ValueError, match="version 1"):
        scans.read_index(spark, str(tmp_path / "i"), "blocks")


def test_sessions_equal_a_fold(spark):
    r = random.Random(8)
    calls = [(k, r.choice(["a", "b", None, "hot", "hot"]), k, *r.choice([("search", r.choice("xyz"), None), ("open", None, r.choice(["x1", "x2", "y1", "z1", "gone"])), ("other", None, None)])) for k in range(60)]
    returned = [("x", "x1"), ("x", "x2"), ("y", "y1"), ("z", "gone")]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    told = sessions.outcomes(frame(calls, "id int, session string, at int, kind string, query string, passage_id string"), frame(returned, "query string, passage_id string"), frame([("x1",), ("x2",), ("y1",), ("z1",)], "passage_id string"), "session", F.floor(F.col("at") / 7), ["at"], 9, 3)
    state, want = {}, []
    for k, who, _, kind, query, passage in calls:
        s = state.setdefault(who, [0, 0, set()])
        s[0] += 1
        s[1] += kind == "search"
        out = "done"
        if s[0] > 9:
            out = "calls spent"
        elif kind == "search":
            out = "searches spent" if s[1] > 3 else out
            s[2] |= {p for q, p in returned if q == query} if s[1] <= 3 else set()
        elif kind == "open":
            out = "not found before" if passage not in s[2] else "no such passage" if passage == "gone" else out
        want.append((k, out))
    assert rows(told, "id", "outcome") == want and {o for _, o in want} == set(sessions.OUTCOMES)
    recorded = told.select("session", "at", "kind", F.when(F.col("id") == 3, "done?").otherwise(F.col("outcome")).alias("outcome"))
    assert [r.recorded for r in sessions.replayed(recorded, told, "session", ["at"]).where("session is not null").collect()] in (["done?"], [])
    assert {p for _, p in ((r.session, r.passage_id) for r in sessions.opened(told, "session").collect())} <= {"x1", "x2", "y1"}


@pytest.mark.parametrize("together", [20_000, 5])
def test_linkage_equals_a_fold(spark, together):
    r = random.Random(6)
    data = [(b, i, r.choice(["", f"10.1/{r.randint(0, 80)}"]), r.choice(["", f"W{r.randint(0, 80)}"]), r.choice(["", f"t{r.randint(0, 9)}"])) for b in "ab" for i in range(150)]
    got = linkage.dedup(spark.createDataFrame(data, "block string, position long, doi string, id string, title string"), "block", together)
    want = []
    for b in "ab":
        keys = [[f"doi:{d}"] * bool(d) + [f"id:{w.lower()}"] * bool(w) or [f"title:{t}"] * bool(t) for c, _, d, w, t in data if c == b]
        want += [(b, *x) for x in linkage.fold(list(range(150)), keys)]
    assert sorted(map(str, rows(got.fillna("", ["matched"]), "block", "position", "kept_position", "matched"))) == sorted(str((b, p, k, m or "")) for b, p, k, m in want)


def test_a_chain_of_ten_thousand_records(spark):
    data = [("c", k, f"10.1/{k}", f"W{k + 1}" if k % 2 else f"W{k}", "") for k in range(10_000)]
    data = [("c", k, f"10.1/{k // 2}", f"W{(k + 1) // 2}", "") for k in range(10_000)]
    got = linkage.dedup(spark.createDataFrame(data, "block string, position long, doi string, id string, title string"), "block")
    want = linkage.fold(list(range(10_000)), [[f"doi:{d}", f"id:{w.lower()}"] for _, _, d, w, _ in data])
    assert rows(got, "position", "kept_position") == [(p, k) for p, k, _ in want]


def test_discovery_log_counts_what_is_dropped(spark):
    data = [("q", k, "", f"W{k % 4}", "") for k in range(10)]
    log = linkage.discovery_log(linkage.discovery(spark.createDataFrame(data, "block string, position long, doi string, id string, title string"), "block", 3)).first()
    assert tuple(log) == ("q", 10, 6, 4, 1)


def test_path_candidates_are_few_and_complete(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 9)))
    names = sorted({" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(400)})
    asked = [(k, "".join(c for c in n if r.random() > 0.1) or "x") for k, n in enumerate(r.sample(names, 25))] + [(90, "zzzz")]
    missing = spark.createDataFrame([(k, f"d/{n}.PDF") for k, n in asked], "document_id int, relative_path string")
    catalogue = spark.createDataFrame([(f"{n}.pdf",) for n in names] + [(None,), (f"{names[0]}.pdf",)], "path string")
    key = lambda n: " ".join(n.lower().split())
    for least in (0.0, 0.6):
        want = []
        for k, n in asked:
            best = sorted((-difflib.SequenceMatcher(None, key(n), key(c)).ratio(), f"{c}.pdf") for c in names)[:3]
            want += [(k, j, p, -x) for j, (x, p) in enumerate(best, 1) if -x >= least]
        assert rows(preflight.suggestions(missing, catalogue, least), "document_id", "rank", "path", "ratio") == sorted(want)
    # where several alike ones are known, hardly another is looked at
    known = spark.createDataFrame([(f"{n} vol {v}", f"{n} vol {v}") for n in names for v in range(4)], "path string, b string")
    looked = preflight.candidates(spark.createDataFrame([(k, f"{names[k]} vl 1") for k in range(0, 400, 16)], "document_id int, a string"), known, 0.0, 3)
    assert looked.count() < 0.1 * 25 * 1600


def test_lines_of_split_files(spark, tmp_path):
    said = [json.dumps({"page": k % 7, "text": f"t{k}" + "x" * (k % 50)}) for k in range(3000)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.jsonl").write_text("\n".join(said[:2000]) + "\n\n")
    (tmp_path / "f" / "b.jsonl").write_text("\n".join(said[2000:]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "f"))
        assert spark.read.text(str(tmp_path / "f")).rdd.getNumPartitions() > 8
        assert [(r.position, r.value) for r in got.orderBy("position").collect()] == list(enumerate([*said[:2000], "", *said[2000:]]))
        assert got.where("path like '%b.jsonl'").agg(F.min("line"), F.max("line")).first() == (0, 999)
        last = files.last_line_per_key(spark, str(tmp_path / "f"), "page int, text string", "page")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert rows(last, "page", "text") == sorted({json.loads(x)["page"]: json.loads(x)["text"] for x in said}.items())
    assert files.last_line_per_key(spark, str(tmp_path / "none"), "page int, text string", "page").count() == 0


def test_documents_are_written_in_order_and_compared(spark, tmp_path):
    said = [(k, f"line {k}" if k % 9 else None) for k in range(500)]
    lines = spark.createDataFrame(random.Random(1).sample(said, 500), "k int, value string").repartition(7)
    a, b, c = (str(tmp_path / x) for x in "abc")
    reports.write_document(lines, ["k"], a)
    assert [(r.position, r.value) for r in reports.document(spark, a).orderBy("position").collect()] == [(k, v or "") for k, v in said]
    reports.write_document(lines.coalesce(1), ["k"], b)
    reports.write_document(lines.withColumn("value", F.when(F.col("k") == 77, "other").otherwise(F.col("value"))).where("k < 499"), ["k"], c)
    assert reports.same(spark, a, b) and not reports.same(spark, a, c)
    assert rows(reports.differing(spark, a, c).fillna("none"), "position", "a", "b") == [(77, "line 77", "other"), (499, "line 499", "none")]
    parts = reports.lines_of(F.col("t"), spark.createDataFrame([(1, "x\ny"), (2, None)], "k int, t string"), "k")
    assert rows(parts, "k", "at", "value") == [(1, 0, "x"), (1, 1, "y")]
    summary = spark.createDataFrame([("dense", 1.0, 0.5, 0.25), ("lexical", 0.0, 0.0, 0.0)], "mode string, hit_at_3 double, mrr double, ndcg_at_5 double")
    each = spark.createDataFrame([(12, "dense", 1, 0.5, 0.25), (12, "lexical", 0, 0.0, 0.0), (3, "dense", 1, 1.0, 1.0)], "query_id int, mode string, hit_at_3 int, mrr double, ndcg_at_5 double")
    reports.write_document(reports.evaluation_report(summary, each, ("lexical", "dense"), {"questions": 2}), ["part", "key", "at"], c)
    assert [r.value for r in reports.document(spark, c).orderBy("position").collect()] == [
        "# Evaluation", "", "- questions: 2", "", "| mode | Hit@3 | MRR | nDCG@5 |", "| --- | ---: | ---: | ---: |", "| lexical | 0.000 | 0.000 | 0.000 |", "| dense | 1.000 | 0.500 | 0.250 |",
        "", "## 3", "- dense: Hit@3 1; RR 1.000; nDCG@5 1.000", "", "## 12", "- lexical: Hit@3 0; RR 0.000; nDCG@5 0.000", "- dense: Hit@3 1; RR 0.500; nDCG@5 0.250"]


def test_manifest_files_and_lock(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",".join(scans.MANIFEST_FIELDS) + "\n")
    head = scans.MANIFEST_FIELDS
    value = {"document_id": "d1", "relative_path": "a/b.pdf", "text_policy": "auto", "start_page": "2", "max_pages": "all", "title": "T"}
    for bad, message in (({}, None), ({"relative_path": "../b.pdf"}, "outside"), ({"text_policy": "none"}, "outside"), ({"document_id": ""}, "empty or repeated")):
        (tmp_path / "m.csv").write_text(",".join(head) + "\n" + ",".join((value | bad).get(c, "") for c in head) + "\n")
        if message is None:
            made = scans.manifest(spark, str(tmp_path / "m.csv")).first()
            assert (made.document_id, made.start_page, made.max_pages, made.end_page, made.author) == ("d1", 2, None, None, "")
        else:
            with pytest.raises(ValueError, match=message):
                scans.manifest(spark, str(tmp_path / "m.csv"))
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.pdf").write_bytes(b"one")
    (tmp_path / "d" / "y.txt").write_bytes(b"two")
    found = files.files(spark, str(tmp_path / "d"))
    assert [(r.path.rsplit("/", 1)[1], r.digest) for r in found.collect()] == [("x.pdf", "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed")]
    lock = spark.createDataFrame([("x.pdf", "0" * 64)], "name string, digest string")
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "digest")
    assert [(r.rule, r.key, r.message) for r in governance.changed(named, lock).collect()] == [("freeze", "x.pdf", "changed after the lock")]


def test_sums_of_a_write(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 2 == 0, F.col("id")))
    seen = scans.write_counted(df.repartition(5), str(tmp_path / "t"), {"rows": F.count("*"), "known": F.count("x"), "total": F.sum("x")})
    assert seen == {"rows": 1000, "known": 500, "total": 249500} and spark.read.parquet(str(tmp_path / "t")).count() == 1000
    assert scans.write_counted(df.limit(0), str(tmp_path / "u"), {"rows": F.count("*"), "total": F.sum("x")}) == {"rows": 0, "total": 0}
    scans.write_document({"b": 1, "a": "é"}, str(tmp_path / "j"), spark)
    assert files.read_json(spark, str(tmp_path / "j"), "a string, b int", ("a", "b")).first() == ("é", 1)


def space(spark, root):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    evidence = "evidence_id string, source_id string, claim_id string, study_design string, population string, outcome string, verbatim_excerpt string, locator string"
    return gates.created(spark, str(root), {
        "screening_pending": frame([("T1", "t"), ("T2", "t")], "record_id string, title string"), "screening_decisions": frame([("T0", "exclude", "r", "x")], "record_id string, human_decision string, human_reason string, reviewer string"),
        "evidence_pending": frame([(f"E{k}", f"T{k}", "C", "s", "p", "o", "v", "l", "said") for k in (0, 1, 2)], evidence + ", ai_interpretation string"),
        "evidence_verifications": frame([], "evidence_id string, source_id string, verdict string, human_correction string, reviewer string"),
        "evidence_ledger": frame([("E9", "T9", "C", "s", "p", "o", "v", "l", "final", "x")], evidence + ", final_interpretation string, reviewer string"),
    })


def test_gates_commit_once(spark, tmp_path):
    first = space(spark, tmp_path / "w")
    decision = lambda *d: spark.createDataFrame([d], "record_id string, human_decision string, human_reason string, reviewer string")
    verdict = lambda *d: spark.createDataFrame([d], "evidence_id string, verdict string, human_correction string, reviewer string")
    now = gates.screen(first, decision("T1", "include", "ok", "ana"))
    with pytest.raises(gates.Stale):  # decided on what is not current any more
        gates.screen(first, decision("T2", "exclude", "ok", "eva"))
    assert gates.opened(spark, str(tmp_path / "w")).version == 2 and rows(now.read("screening_pending"), "record_id") == [("T2",)]
    assert rows(now.read("trace"), *gates.TRACE) == [("screening", "T1", "human_decision", "screening_decisions", "include")]
    for bad in (verdict("E0", "verified", "", "ana"), verdict("E2", "verified", "", "ana"), verdict("E7", "rejected", "", "ana")):
        with pytest.raises(ValueError):
            gates.verify(now, bad)
    with pytest.raises(ValueError):
        gates.screen(now, decision("T2", "include", " ", "ana"))
    done = gates.verify(gates.verify(now, verdict("E1", "verified", " better ", "ana")), verdict("E2", "rejected", None, "eva"))
    ledger = {r.evidence_id: (r.final_interpretation, r.reviewer) for r in done.read("evidence_ledger").collect()}
    assert ledger["E1"] == ("better", "ana") and ledger["E9"] == ("final", "x") and len(ledger) == 2
    assert rows(done.read("evidence_pending"), "evidence_id") == [("E0",)] and done.read("trace").count() == 3 and not gates.lock_problems(done)
    again = gates.opened(spark, str(tmp_path / "w"))
    assert again == done and gates.lock_problems(gates.Workspace(spark, done.root, done.version, done.folders, {"screening_decisions": "other"})) == ["screening_decisions"]


def test_types_from_every_row(spark):
    df = spark.createDataFrame([("1", "1", "true", " ", "1", "x", "9" * 19)] * 50 + [("2", ".5", "FALSE", None, "true", "1", "1")], "a string, b string, c string, d string, e string, f string, `g.h` string")
    assert rows(files.inferred(df), "name", "kind") == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "missing"), ("e", "string"), ("f", "string"), ("g.h", "double")]
    made = files.typed(df)
    assert dict(made.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "string", "g.h": "double"}
    assert made.agg(F.sum("a"), F.sum("b")).first() == (52, 50.5) and {r.kind for r in files.inferred(df.limit(0)).collect()} == {"missing"}


def test_cache_name(spark):
    of = lambda name, d: spark.range(1).select(text.cache_name(F.lit(name), F.lit(d)).alias("x")).first().x
    assert of("Ánna's Book 2", "ab" * 32) == "nna-s-book-2.abababababab.jsonl"
    for name, d in (("¡!", "ab" * 32), ("a", "xyz")):
        with pytest.raises(Exception, match="letters|digest"):
            of(name, d)


def test_manifest_files_and_calibration(spark, tmp_path):
    assert scans.matching_calibration({"mode": "dense", "model": "m", "min_top_score": 0.5, "gap": 0.1, "separable": True}, "dense", "m")["gap"] == 0.1
    for bad in ({"mode": "dense"}, {"mode": "dense", "model": "n", "min_top_score": 0.5, "gap": 0.1, "separable": True}):
        with pytest.raises(ValueError):
            scans.matching_calibration(bad, "dense", "m")
    with pytest.raises(ValueError):
        scans.matching_calibration({"mode": "lexical", "model": "m", "min_top_score": 0.5, "gap": 0.1, "separable": True}, "lexical", "m")
    assert callable(governance.decide)
