import difflib
import random

import pytest
from pyspark.sql import functions as F

from tamiz.operators import answers, governance, linkage, preflight
from tamiz.sources import scans


def broken(df):
    return sorted((r.rule, r.key, r.message) for r in df.collect())


EVIDENCE = "evidence_id string, source_id string, study_design string, population string, outcome string, verbatim_excerpt string, locator string"


def review(spark, pending=(), decisions=(("T1", "include", "r"),), proposals=(), verdicts=(("E1", "verified"),), said="se asocia con"):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    row = ("E1", "T1", "encuesta", "adultos", "o", "a b c", "p. 1")
    return governance.review(
        frame([("T1",)], "record_id string"), frame(pending, "record_id string"), frame(decisions, "record_id string, human_decision string, human_reason string"), frame(proposals, EVIDENCE + ", ai_interpretation string"),
        frame(verdicts, "evidence_id string, verdict string"), frame([(*row, said)], EVIDENCE + ", final_interpretation string"),
        frame([("T1", "encuesta", "adultos", "o", "a b c", "p. 1")], "source_id string, design string, population string, outcome string, excerpt string, locator string"), population="adultos",
    )


def test_review_rules(spark):
    assert broken(review(spark)) == []
    assert broken(review(spark, said="el crédito redujo la pobreza")) == [("causal-language", "E1", "uses redujo")]
    assert broken(review(spark, verdicts=[])) == [("ledger", "E1", "official without a verification")]
    assert broken(review(spark, decisions=[("T1", "exclude", " "), ("X", "include", "r")])) == [
        ("ledger", "E1", "record screened as exclude"), ("screening", "T1", "decision without a reason"), ("screening", "X", "unknown record")]
    assert broken(review(spark, proposals=[("E2", "T9", "", "", "", "", "", "")])) == [("anchor", "E2", "not in the packet: T9"), ("gate", "E2", "verification pending")]


def test_referee_rules(spark):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    ledger = "point_id string, evidence_line string, evidence_quote string, response_type string, change_file string, decision string"
    row = ("R1", "M1", "old", "change", "d.diff", "approve")
    args = [frame([("R1",)], "point_id string"), frame([], ledger), frame([row], ledger), frame([("R1", "approve")], "point_id string, decision string"), frame([("M1", "old")], "id string, text string"), frame([("d.diff", "removed", "old"), ("d.diff", "added", "new")], "path string, kind string, text string")]
    assert broken(governance.referee(*args)) == []
    args[5] = frame([("d.diff", "added", "old")], "path string, kind string, text string")
    args[3] = frame([("R2", "approve")], "point_id string, decision string")
    assert broken(governance.referee(*args)) == [("change", "R1", "diff keeps its anchored line"), ("gate", "R2", "approved without a proposal"), ("ledger", "R2", "decided but not official")]


def test_workspace_and_guided_rules(spark):
    candidates = spark.createDataFrame([("R1", "10.1234/ab", "", "include", "yes"), ("R2", "", "perhaps", "", "yes")], "record_id string, doi string, ai_proposal string, human_decision string, human_checked string")
    evidence = spark.createDataFrame([("R1", "x y", "p. 1", "yes"), ("R9", "w " * 26, "", "yes")], "record_id string, verbatim_excerpt string, locator string, human_verified string")
    lines = spark.createDataFrame([(1, "Según R1 y R2 (10.1234/AB)."), (2, "## Procedencia"), (3, "R3")], "line int, value string")
    assert broken(governance.workspace(candidates, evidence, lines)) == [
        ("candidates", "R2", "ai_proposal not allowed"), ("candidates", "R2", "checked without a decision"), ("evidence", "R9", "excerpt too long"), ("evidence", "R9", "record not among the candidates"),
        ("evidence", "R9", "verified without a locator"), ("synthesis", "r2", "cites what is not verified")]
    sources = spark.createDataFrame([("S1", True), ("S2", False)], "source_id string, causal boolean")
    rows = spark.createDataFrame([("S2", "aprobar", "r", "", "El programa redujo")], "source_id string, decision string, reason string, signature string, claim string")
    chosen = spark.createDataFrame([("S1",), ("S2",), ("S7",)], "source_id string")
    assert broken(governance.guided(chosen, rows, sources)) == [
        ("causal-language", "S2", "the design does not admit causal words"), ("decision", "S1", "no decision"), ("decision", "S2", "no signature"), ("selection", "S7", "unknown source"), ("selection", "selection", "choose one or two")]


def test_gate_and_brief(spark):
    pending = spark.createDataFrame([("T1", "t"), ("T2", "t")], "record_id string, title string")
    ledger = spark.createDataFrame([("T0", "exclude", "r")], "record_id string, human_decision string, human_reason string")
    left, now = governance.decide(pending, ledger, spark.createDataFrame([("T1", "include", "ok")], ledger.schema), "record_id", "human_reason")
    assert [r.record_id for r in left.collect()] == ["T2"] and sorted(r.record_id for r in now.collect()) == ["T0", "T1"]
    with pytest.raises(ValueError):
        governance.decide(pending, ledger, spark.createDataFrame([("T1", "include", " ")], ledger.schema), "record_id", "human_reason")
    rows = [(c, e, "dice", "T1", "encuesta", "adultos", "o", "x", "p. 1", "AB") for c, e in (("C2", "E1"), ("C1", "E2"))]
    made = governance.brief(spark.createDataFrame(rows, "claim_id string, evidence_id string, final_interpretation string, source_id string, study_design string, population string, outcome string, verbatim_excerpt string, locator string, reviewer string"), "# B\n\n").first().text
    part = "\n\ndice\n\n- Fuente · T1 (encuesta, adultos)\n- Resultado medido · o\n- Pasaje · «x»\n- Localizador · p. 1\n- Verificado por · AB"
    assert made == f"# B\n\n## C1 · E2{part}\n\n## C2 · E1{part}\n"


def test_suggestions_equal_brute_force(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 12))).strip() + "x" for _ in range(40)]
    missing = spark.createDataFrame([(k, f"d/{n}q.PDF") for k, n in enumerate(names[:8])], "document_id int, relative_path string")
    got = {(r.document_id, r["rank"]): (r.path, r.ratio) for r in preflight.suggestions(missing, spark.createDataFrame([(f"{n}.pdf",) for n in names], "path string")).collect()}
    key = lambda n: " ".join(n.split())
    for k, n in enumerate(names[:8]):
        want = sorted(((-difflib.SequenceMatcher(None, key(n + "q"), key(c)).ratio(), f"{c}.pdf") for c in names))[:3]
        assert [got[k, j] for j in (1, 2, 3)] == [(p, -r) for r, p in want]
    offered = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.86, 2), (2, "a", 0.8, 1), (2, "b", 0.75, 2), (3, "a", 0.71, 1), (4, "c", 0.72, 1)], "document_id int, path string, ratio double, rank int")
    assert sorted((r.document_id, r.to) for r in preflight.fixes(offered).collect()) == [(2, "a"), (4, "c")]


def test_page_text_and_scope(spark):
    rows = [("digital", "ab", "abcd", "ab"), ("auto", "a" * 200, "b" * 300, "a" * 200), ("auto", "ab", "abc", "abc"), ("ocr", "ab", "cd", "ab"), ("ocr", None, None, "")]
    df = spark.createDataFrame(rows, "policy string, own string, ocr string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", preflight.page_text(F.col("policy"), F.col("own"), F.col("ocr"))).collect())
    scopes = spark.createDataFrame([("digital", 3), ("glued", 3), ("mixed", 3), ("mixed", 0), (None, 2)], "l string, n int").select(preflight.scope(F.col("l"), F.col("n")).alias("s"))
    assert [r.s for r in scopes.collect()] == ["none", "full-scan", "mixed-gaps", "none", "none"]


def test_answers(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    results = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.9)], "query_id int, score double")
    picks = spark.createDataFrame([(1, 2, "dos", True), (1, 1, "uno", True), (2, 1, "x", True), (3, 1, "tres", True)], "query_id int, marker int, quote string, grounded boolean")
    made = spark.createDataFrame([(1, "Inventado [3]."), (3, answers.ABSTAIN)], "query_id int, text string")
    got = {r.query_id: (r.answered, r.generator, r.answer, r.problems) for r in answers.build(asked, results, picks, 0.5, made).collect()}
    assert got == {1: (True, "extractive", "«uno» [1]\n\n«dos» [2]", []), 2: (False, "abstained", answers.ABSTAIN, []), 3: (False, "generated", answers.ABSTAIN, []), 4: (False, "abstained", answers.ABSTAIN, [])}
    wrong = spark.range(1).select(answers.problems(F.lit("a [0] b [9]"), F.lit(2), F.lit(True)).alias("p")).first().p
    assert wrong == ["cites sources it was not given: [0], [9]"]


def test_discovery_and_scans(spark, tmp_path):
    rows = [("q", 0, "", "W1", "a"), ("q", 1, "", "", "t"), ("q", 2, "", "w1", "b"), ("q", 3, "", "", "T!"), ("q", 4, "", "", "u")]
    got = {r.position: (r.candidate_id, r.duplicate, r.matched, r.within) for r in linkage.discovery(spark.createDataFrame(rows, "block string, position long, doi string, id string, title string"), "block", 2).collect()}
    assert got == {0: ("D01", False, None, True), 1: ("D02", False, None, True), 2: ("D01", True, "id:w1", True), 3: ("D02", True, "title:t", True), 4: ("D03", False, None, False)}
    kind = "id string, doi string, display_name string, title string, publication_year int, type string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, host_venue struct<display_name:string>, abstract_inverted_index map<string,array<int>>"
    nested = spark.createDataFrame([("q", 0, ("https://openalex.org/W7", "https://doi.org/10.1/X", "", " A  b", 2020, "article", [(("Ana",),)], (None,), ("Rev",), {"a": [1]})), ("q", 1, (None,) * 10)], f"query_id string, position int, work struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    a, b = scans.works(nested).orderBy("position").collect()
    assert (a.title, a.year, a.doi, a.id, a.venue, a.first_author, a.n_authors, a.has_abstract) == ("A b", "2020", "10.1/x", "W7", "Rev", "Ana", 1, True)
    assert (b.title, b.doi, b.n_authors, b.has_abstract) == ("", "", 0, False)
    (tmp_path / "q.csv").write_text(",".join(scans.QUESTION_FIELDS) + "\nq1,c,t,¿a?,d,r,p\n")
    (tmp_path / "r.csv").write_text(",".join(scans.QREL_FIELDS) + "\nq1,d,3,5,1,ana,,\n")
    asked = scans.questions(spark, str(tmp_path / "q.csv"))
    assert asked.count() == 1
    with pytest.raises(ValueError, match="bad judgment"):
        scans.qrels(spark, str(tmp_path / "r.csv"), asked)
    paths = spark.createDataFrame([("a/../b", True), ("../b", False), ("/a", False), ("a/../../b/c", False)], "p string, ok boolean")
    assert all(r.got == r.ok for r in paths.withColumn("got", scans.contained(F.col("p"))).collect())
    live, old = spark.createDataFrame([("a", 1)], "query_id string, n int"), spark.createDataFrame([("a", 2), ("b", 3)], "query_id string, n int")
    assert sorted(tuple(r) for r in scans.served(live, old).collect()) == [("a", 1, "live"), ("b", 3, "recorded")]
