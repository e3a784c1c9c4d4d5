"""Rule checks on review ledgers, gates and deterministic rendering (CHK-03 to CHK-06, CHK-09, STM-01, STM-02, RND-01).

A validator gives rows of (rule, key, message), none if all rules hold. Each joins its tables once and tests all rules of a row together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.operators import audit

# Vocabularies of the review protocol.
SCREENING_STATES = ("include", "exclude", "uncertain", "editorial_flag")
CAUSAL_DESIGNS = ("experimento aleatorizado", "experimento de campo aleatorizado")
CAUSAL_PHRASES = (
    "causa", "causó", "provoca", "provocó", "produce", "produjo", "el efecto de", "efecto causal", "reduce", "redujo", "hace que", "lleva a", "impacta",
    "impactó", "gracias a", "debido al asistente",
)
CAUSAL_STEMS = ("caus", "efecto", "aumentó", "redujo", "provoc", "generó")


def blank(c: str | Column) -> Column:
    return text.strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def found(rows: DataFrame, key: str, *checks: tuple[str, Column, str | Column]) -> DataFrame:
    """A row for each of ``checks`` (rule, condition that breaks it, message) that a row meets; a null condition breaks nothing."""
    hits = [F.when(c, F.struct(F.lit(rule).alias("rule"), (F.lit(m) if isinstance(m, str) else F.coalesce(m, F.lit(""))).alias("message"))) for rule, c, m in checks]
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.rule", "key", "x.message")


def presence(on: str, **tables: DataFrame) -> DataFrame:
    """Of each key, the number of its rows in each of ``tables``: one shuffle of counts."""
    every = None
    for name, t in tables.items():
        one = t.select(F.col(on), *[F.lit(int(n == name)).alias(n) for n in tables])
        every = one if every is None else every.unionByName(one)
    return every.groupBy(on).agg(*[F.sum(n).alias(n) for n in tables])


def changed(files: DataFrame, lock: DataFrame) -> DataFrame:
    """SRC-17 against HSH-01: (name, digest) of files whose digest isn't the locked one, or that the lock doesn't name."""
    met = files.select("name", "digest").join(lock.select("name", F.col("digest").alias("locked")), "name", "left")
    return found(met, "name", ("freeze", F.col("locked").isNull(), "not in the lock"), ("freeze", F.col("locked") != F.col("digest"), "changed after the lock"))


def review(
    candidates: DataFrame, pending: DataFrame, decisions: DataFrame, proposals: DataFrame, verifications: DataFrame, ledger: DataFrame, packet: DataFrame, *,
    population: str, most_words: int = 25, states: tuple[str, ...] = SCREENING_STATES, causal_designs: tuple[str, ...] = CAUSAL_DESIGNS, phrases: tuple[str, ...] = CAUSAL_PHRASES,
) -> DataFrame:
    """CHK-03: coverage of the screening, anchors in the packet, causal language, and what makes evidence official. Columns as in the protocol's files.

    ``packet``: source_id, design, population, outcome, excerpt, locator. File digests are checked by ``changed``, the brief by ``brief``.
    """
    seen = presence("record_id", candidates=candidates, pending=pending, decisions=decisions)
    screening = found(
        seen, "record_id",
        ("screening", F.col("candidates") == 0, "unknown record"), ("screening", F.greatest("pending", "decisions") > 1, "duplicated"),
        ("screening", (F.col("pending") > 0) & (F.col("decisions") > 0), "still pending after a decision"),
        ("screening", (F.col("candidates") > 0) & (F.col("pending") + F.col("decisions") == 0), "missing"), ("gate", F.col("pending") > 0, "screening decision pending"),
    )
    decided = found(decisions, "record_id", ("screening", ~F.coalesce("human_decision", F.lit("")).isin(*states), "decision is none of the known ones"), ("screening", blank("human_reason"), "decision without a reason"))

    shared = ["evidence_id", "source_id", "study_design", "population", "outcome", "verbatim_excerpt", "locator"]
    official = ledger.select(*shared, F.col("final_interpretation").alias("said"), F.lit(True).alias("official"))
    proposed = proposals.select(*shared, F.col("ai_interpretation").alias("said"), F.lit(False).alias("official"))
    source = packet.select("source_id", F.struct("design", "population", "outcome", "excerpt", "locator").alias("p"))
    p = lambda name: F.coalesce(F.col("p")[name], F.lit(""))
    own = lambda name: F.coalesce(F.col(name), F.lit(""))
    known, causal = F.col("p").isNotNull(), text.first_phrase(F.col("said"), list(phrases))
    anchors = found(
        audit.override(official, proposed, ["evidence_id"]).join(source, "source_id", "left"), "evidence_id",
        ("anchor", ~known, F.concat(F.lit("not in the packet: "), own("source_id"))), ("anchor", known & (own("verbatim_excerpt") != p("excerpt")), "excerpt differs"),
        ("anchor", known & (own("locator") != p("locator")), "locator differs"), ("anchor", known & (text.word_count(F.col("verbatim_excerpt")) > most_words), "excerpt too long"),
        ("design", known & (own("study_design") != p("design")), "design differs"), ("population", known & (own("population") != p("population")), "population differs"),
        ("outcome", known & (own("outcome") != p("outcome")), "outcome differs"),
        ("causal-language", known & causal.isNotNull() & ~p("design").isin(*causal_designs), F.concat(F.lit("uses "), causal)),
    )

    evidence = presence("evidence_id", proposals=proposals, ledger=ledger, verifications=verifications)
    verdicts = evidence.join(verifications.groupBy("evidence_id").agg(F.max("verdict").alias("verdict")), "evidence_id", "left")
    legal = found(
        verdicts, "evidence_id",
        ("evidence", F.greatest("proposals", "ledger") > 1, "duplicated"), ("gate", F.col("proposals") > 0, "verification pending"),
        ("ledger", (F.col("ledger") > 0) & (F.col("verifications") == 0), "official without a verification"),
        ("ledger", (F.col("ledger") > 0) & (F.col("verdict") != "verified"), F.concat(F.lit("official but the verdict is "), F.col("verdict"))),
        ("ledger", (F.col("ledger") + F.col("proposals") == 0) & (F.col("verdict") == "verified"), "verified but never official"),
    )
    outcome = decisions.groupBy(F.col("record_id").alias("source_id")).agg(F.max("human_decision").alias("decision"))
    descent = found(
        official.join(outcome, "source_id", "left"), "evidence_id",
        ("ledger", F.col("decision").isNull(), "no screening decision"), ("ledger", F.col("decision") != "include", F.concat(F.lit("record screened as "), F.col("decision"))),
        ("ledger", own("population") != population, "studied another population"),
    )
    claimed = official.select("source_id").unionByName(proposed.select("source_id"))
    idle = found(packet.join(outcome.where("decision = 'include'"), "source_id", "left_semi").join(claimed, "source_id", "left_anti"), "source_id", ("evidence", F.lit(True), "included, but no evidence is given"))
    return screening.unionByName(decided).unionByName(anchors).unionByName(legal).unionByName(descent).unionByName(idle)


def referee(points: DataFrame, pending: DataFrame, ledger: DataFrame, approvals: DataFrame, manuscript: DataFrame, diffs: DataFrame) -> DataFrame:
    """CHK-04 over points (point_id), proposals and ledger (point_id, evidence_line, evidence_quote, response_type, change_file, decision),
    approvals (point_id, decision), manuscript (id, text) and diff lines (path, kind, text) of SRC-18."""
    columns = ["point_id", "evidence_line", "evidence_quote", "response_type", "change_file", "decision"]
    active = audit.override(ledger.select(*columns), pending.select(*columns), ["point_id"], F.col("decision") == "reject")
    ruled = ledger.groupBy("point_id").agg(F.max("decision").alias("ruling"))
    seen = presence("point_id", points=points, pending=pending, ledger=ledger).join(ruled, "point_id", "left").join(approvals.groupBy("point_id").agg(F.max("decision").alias("approved")), "point_id", "full")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    there = n("pending") + n("ledger") > 0
    final = F.coalesce(F.col("ruling").isin("approve", "no_change"), F.lit(False)) & (n("pending") == 0)
    state = found(
        seen, "point_id",
        ("coverage", (n("points") > 0) & ~there, "missing"), ("coverage", (n("points") == 0) & there, "unknown"),
        ("coverage", (F.greatest(n("pending"), n("ledger")) > 1) | ((n("pending") > 0) & (n("ledger") > 0) & (F.coalesce("ruling", F.lit("")) != "reject")), "duplicated"),
        ("gate", F.col("approved").isNotNull() & ~there, "approved without a proposal"), ("ledger", F.col("approved").isNotNull() & (n("ledger") == 0), "decided but not official"),
        ("ledger", (n("ledger") > 0) & (F.col("approved") != F.coalesce("ruling", F.lit(""))), "decision disagrees with the approvals"), ("gate", there & ~final, "decision pending"),
    )
    edits = diffs.groupBy(F.col("path").alias("change_file")).agg(F.collect_list(F.when(F.col("kind") == "removed", F.col("text"))).alias("removed"), F.collect_list(F.when(F.col("kind") == "added", F.col("text"))).alias("added"))
    met = active.join(manuscript.select(F.col("id").alias("evidence_line"), F.col("text").alias("line")), "evidence_line", "left").join(edits, "change_file", "left")
    change = F.coalesce("response_type", F.lit("change")) == "change"
    distinct = F.exists("added", lambda x: (x != "") & ~F.array_contains("removed", x))
    anchors = found(
        met, "point_id",
        ("anchor", F.col("line").isNull(), "line not in the manuscript"), ("anchor", F.col("line") != F.coalesce("evidence_quote", F.lit("")), "quote differs"),
        ("change", change & F.col("removed").isNull(), "no diff"), ("change", change & F.col("removed").isNotNull() & ~F.array_contains("removed", F.coalesce("line", F.lit(""))), "diff keeps its anchored line"),
        ("change", change & F.col("removed").isNotNull() & ~distinct, "diff adds nothing new"),
    )
    return state.unionByName(anchors)


def workspace(candidates: DataFrame, evidence: DataFrame, synthesis: DataFrame, most_words: int = 25) -> DataFrame:
    """CHK-05 over the files' columns and the synthesis's lines (line, value): vocabularies, excerpts, and citations of verified records only."""
    decisions, checks = ("", *SCREENING_STATES, "pending"), ("", "yes", "no")
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    ids = found(audit.duplicates(candidates, ["record_id"]), "record_id", ("candidates", F.lit(True), "record_id empty or duplicated"))
    rows = found(
        candidates, "record_id",
        ("candidates", ~value("ai_proposal").isin(*decisions), "ai_proposal not allowed"), ("candidates", ~value("human_decision").isin(*decisions), "human_decision not allowed"),
        ("candidates", ~value("human_checked").isin(*checks), "human_checked is yes or no"), ("candidates", (value("human_checked") == "yes") & (value("human_decision") == ""), "checked without a decision"),
    )
    excerpt, yes = text.strip(value("verbatim_excerpt")), value("human_verified") == "yes"
    own = candidates.groupBy("record_id").agg(F.max(F.lower(text.strip(value("doi")))).alias("doi"), F.lit(True).alias("known"))
    met = evidence.withColumn("record_id", text.strip(value("record_id"))).join(own, "record_id", "left")
    facts = found(
        met, "record_id",
        ("evidence", ~value("human_verified").isin(*checks), "human_verified is yes or no"), ("evidence", (excerpt != "NO ENCONTRADO") & (text.word_count(excerpt) > most_words), "excerpt too long"),
        ("evidence", yes & blank("locator"), "verified without a locator"), ("evidence", yes & F.col("known").isNull(), "record not among the candidates"),
    )
    verified = met.where(yes)
    allowed = verified.select(F.lower("record_id").alias("cited")).unionByName(verified.where("doi <> ''").select(F.col("doi").alias("cited"))).distinct()
    body = synthesis.where(F.col("line") < F.coalesce(synthesis.where(F.col("value").contains("## Procedencia")).select(F.min("line")).scalar(), F.lit(2**31 - 1)))
    marks = F.array_union(F.transform(F.regexp_extract_all("value", F.lit(r"(?i)\br\d+\b"), F.lit(0)), F.lower), text.identifiers(F.col("value")))
    cited = body.select(F.explode(marks).alias("cited")).distinct()
    wrong = found(cited.join(allowed, "cited", "left_anti"), "cited", ("synthesis", F.lit(True), "cites what is not verified"))
    said, low = text.strip(value("value")), F.lower(text.strip(value("value")))
    content = body.where((said != "") & ~said.startswith("#") & ~low.isin("pendiente.", "pendiente", "-") & ~(said.startswith("-") & said.endswith(":")) & ~said.startswith("**Estado:**"))
    whole = content.agg(F.count("*").alias("n")).join(cited.agg(F.count("*").alias("n_cited"))).join(verified.agg(F.count("*").alias("n_verified"))).withColumn("key", F.lit("synthesis"))
    empty = found(whole, "key", ("synthesis", (F.col("n") > 0) & (F.col("n_verified") == 0), "content without verified evidence"), ("synthesis", (F.col("n") > 0) & (F.col("n_cited") == 0), "content without a record or DOI"))
    return ids.unionByName(rows).unionByName(facts).unionByName(wrong).unionByName(empty)


def guided(selected: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """CHK-06: one or two chosen sources (source_id), each known and with a signed, reasoned decision; observational ones (sources.causal false) without causal words."""
    met = selected.join(sources.select("source_id", "causal"), "source_id", "left").join(rows.withColumn("_row", F.lit(True)), "source_id", "left")
    known, row = F.col("causal").isNotNull(), F.col("_row").isNotNull()
    used = F.col("decision").isin("aprobar", "reescribir")
    each = found(
        met, "source_id",
        ("selection", ~known, "unknown source"), ("decision", known & ~row, "no decision"), ("decision", known & row & ~F.coalesce("decision", F.lit("")).isin("aprobar", "reescribir", "excluir"), "decision open or invalid"),
        ("decision", known & row & blank("reason"), "no reason"), ("decision", known & row & blank("signature"), "no signature"), ("decision", known & row & used & blank("claim"), "no claim"),
        ("causal-language", known & row & used & ~F.col("causal") & text.has_stem(F.col("claim"), list(CAUSAL_STEMS)), "the design does not admit causal words"),
    )
    n = selected.agg(F.count("*").alias("n")).withColumn("key", F.lit("selection"))
    return each.unionByName(found(n, "key", ("selection", ~F.col("n").between(1, 2), "choose one or two")))


def drafts(claims: DataFrame, references: DataFrame, opened: DataFrame, passages: DataFrame) -> DataFrame:
    """CHK-09: (claim_id, verdict, problems) of claims (claim_id, verdict, causal); any problem makes the verdict insufficient.

    ``references``: claim_id, passage_id, relation; ``opened``: claim_id, passage_id; ``passages``: passage_id, causal_strength.
    """
    met = references.join(opened.distinct().withColumn("_open", F.lit(True)), ["claim_id", "passage_id"], "left").join(passages.select("passage_id", "causal_strength"), "passage_id", "left")
    per = met.groupBy("claim_id").agg(
        F.collect_set("relation").alias("relations"), F.max(F.col("_open").isNull()).alias("unopened"),
        F.max((F.col("relation") == "supports") & F.col("_open").isNotNull() & F.coalesce(F.col("causal_strength") == "causal", F.lit(False))).alias("strong"),
    )
    has = lambda r: F.coalesce(F.array_contains("relations", r), F.lit(False))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    verdict = F.col("verdict")
    breaks = [
        (~no("unopened"), "cites what was not opened"), ((verdict == "supported") & ~has("supports"), "supported without support"), ((verdict == "contradicted") & ~has("contradicts"), "contradicted without contradiction"),
        ((verdict == "partially_supported") & ~(has("supports") & (has("context") | has("contradicts"))), "partial without both sides"),
        (F.col("causal") & verdict.isin("supported", "partially_supported") & no("strong"), "causal claim without causal evidence"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in breaks]))
    joined = claims.join(per, "claim_id", "left").withColumn("problems", problems)
    return joined.select("claim_id", F.when(F.size("problems") > 0, "insufficient").otherwise(verdict).alias("verdict"), "problems")


def decide(pending: DataFrame, ledger: DataFrame, decision: DataFrame, on: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """STM-01: (pending, ledger) after ``decision``, rows of the ledger's columns; each must be pending and have a reason, or it is an error."""
    bad = decision.where(blank(reason)).select(on).unionByName(decision.join(pending, on, "left_anti").select(on))
    if not bad.isEmpty():
        raise ValueError("a decision needs a pending row and a reason")
    return pending.join(decision, on, "left_anti"), audit.upsert(ledger, decision.select(*ledger.columns), [on])


def rendered(rows: DataFrame, by: Column, order: list[str], part: Column, head: str = "") -> DataFrame:
    """AGG-15, RND-01: (document, text): the parts of each document in ``order``, a blank line between, under ``head``. Parts of a document must fit in a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_part")))), lambda x: x["_part"])
    return rows.groupBy(by.alias("document")).agg(F.concat(F.lit(head), F.array_join(parts, "\n\n"), F.lit("\n")).alias("text"))


def brief(ledger: DataFrame, head: str = "") -> DataFrame:
    """RND-01: the evidence brief as one text, by claim and evidence."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    lines = [
        F.concat(F.lit("## "), c("claim_id"), F.lit(" · "), c("evidence_id"), F.lit("\n\n"), c("final_interpretation"), F.lit("\n")),
        F.concat(F.lit("- Fuente · "), c("source_id"), F.lit(" ("), c("study_design"), F.lit(", "), c("population"), F.lit(")")), F.concat(F.lit("- Resultado medido · "), c("outcome")),
        F.concat(F.lit("- Pasaje · «"), c("verbatim_excerpt"), F.lit("»")), F.concat(F.lit("- Localizador · "), c("locator")), F.concat(F.lit("- Verificado por · "), c("reviewer")),
    ]
    return rendered(ledger, F.lit("brief"), ["claim_id", "evidence_id"], F.concat_ws("\n", *lines), head)


def clip_problems(clips: DataFrame, key: str, vocabularies: dict[str, tuple[str, ...]], known: DataFrame, reference: str) -> DataFrame:
    """CHK-12: (key, rule): values outside their vocabulary, and references to what isn't known."""
    bad = [F.coalesce(~F.col(c).isin(*allowed), F.lit(True)) for c, allowed in vocabularies.items()]
    outside = clips.where(bad[0] if len(bad) == 1 else F.greatest(*bad)).select(key, F.lit("vocabulary").alias("rule"))
    return outside.unionByName(clips.join(known.select(reference).distinct(), reference, "left_anti").select(key, F.lit("reference").alias("rule")))


def verify(proposals: DataFrame, verdicts: DataFrame, screened: DataFrame, key: str, said: str) -> DataFrame:
    """STM-02: proposals that become official: of records screened as include, those verified, with a correction in place of what was said. A rejected one leaves."""
    met = proposals.join(verdicts.where("verdict = 'verified'").select(key, "human_correction"), key).join(screened.where("decision = 'include'").select(key), key, "left_semi")
    return met.withColumn(said, F.coalesce(F.nullif(F.trim("human_correction"), F.lit("")), F.col(said))).drop("human_correction")


def assembly_problems(exists: bool, text_: str, rendered_: str, open_gates: int) -> list[str]:
    """CHK-03, assembly: a brief may exist only once all gates are closed, and is what the ledger renders."""
    found = []
    if exists and open_gates:
        found.append("written while a decision is open")
    if exists and text_ != rendered_:
        found.append("differs from the ledger")
    return found


def ledger_sources(pages: DataFrame, allowed: tuple[str, ...] = ("embedded", "ocr")) -> DataFrame:
    """CHK-11: pages (document_id, page, source) whose source is missing or unknown."""
    return pages.where(~F.coalesce(F.col("source").isin(*allowed), F.lit(False)))
