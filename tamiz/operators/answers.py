"""Answers made of quotes, with abstention and the citation contract (W4: CHK-08, RET-10, RET-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import text

#: Fixed value: what an answer says when it abstains.
ABSTAIN = "La evidencia recuperada no alcanza para responder esta pregunta con este corpus."


def problems(answer: Column, sources: Column, required: Column) -> Column:
    """CHK-08: why an answer breaks the contract: no citation where one is required, or markers outside 1 to ``sources``."""
    marks = text.citations(answer)
    wrong = F.array_sort(F.array_distinct(F.filter(marks, lambda n: (n < 1) | (n > sources))))
    listed = F.array_join(F.transform(wrong, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    return F.array_compact(F.array(F.when(required & (F.size(marks) == 0), F.lit("no citation")), F.when(F.size(wrong) > 0, F.concat(F.lit("cites sources it was not given: "), listed))))


def quoted(picks: DataFrame) -> DataFrame:
    """RET-10: (query_id, body, sources): the quotes of each query by marker, each with its number."""
    ordered = F.array_sort(F.collect_list(F.struct("marker", "quote")))
    said = F.transform(ordered, lambda x: F.concat(F.lit("«"), x["quote"], F.lit("» ["), x["marker"].cast("string"), F.lit("]")))
    return picks.groupBy("query_id").agg(F.array_join(said, "\n\n").alias("body"), F.count("*").alias("sources"))


def disclosure(picks: DataFrame) -> DataFrame:
    """RET-10: per query, the quotes, words and works that a generator would be sent."""
    return picks.groupBy("query_id").agg(F.count("*").alias("quotes"), F.sum(text.word_count(F.col("quote"))).alias("words"), F.array_sort(F.collect_set("citation")).alias("works"))


def prompt(question: Column, body: Column) -> Column:
    """RET-10: a payload for a generator, made of the question and the numbered quotes alone."""
    rules = f"Respondé solo con los pasajes numerados y citá cada uno con [n]. Si no alcanzan, respondé exactamente: {ABSTAIN}"
    return F.concat(F.lit(rules + "\n\nPregunta: "), question, F.lit("\n\nPasajes:\n"), body, F.lit("\n"))


def build(questions: DataFrame, results: DataFrame, picks: DataFrame, least: float, generated: DataFrame | None = None) -> DataFrame:
    """RET-11: query_id, statistic, margin, answered, generator, answer, sources, problems.

    A query whose best score is under ``least`` (0 without results), or without a grounded quote, abstains. ``generated`` (query_id, text)
    replaces the quotes where it keeps the contract; one that abstains needs no citation, and a broken one is dropped.
    """
    best = results.groupBy("query_id").agg(F.max("score").alias("statistic"))
    met = questions.select("query_id").join(best, "query_id", "left").join(quoted(picks.where("grounded")), "query_id", "left")
    met = met.join(generated.select("query_id", F.col("text").alias("made")), "query_id", "left") if generated is not None else met.withColumn("made", F.lit(None).cast("string"))
    statistic, none = F.coalesce("statistic", F.lit(0.0)), F.coalesce("sources", F.lit(0))
    gave_up = F.coalesce(F.contains(F.col("made"), F.lit(ABSTAIN)), F.lit(False))
    kept = ~F.coalesce(text.strip(F.col("made")) == "", F.lit(True)) & (gave_up | (F.size(problems(F.col("made"), none, F.lit(True))) == 0))
    speaks = (statistic >= least) & (none > 0)
    answer = F.when(~speaks, ABSTAIN).when(kept, F.col("made")).otherwise(F.col("body"))
    told = met.select("query_id", F.round(statistic, 6).alias("statistic"), F.round(statistic - least, 6).alias("margin"), (speaks & ~(kept & gave_up)).alias("answered"), F.when(~speaks, "abstained").when(kept, "generated").otherwise("extractive").alias("generator"), answer.alias("answer"), F.when(speaks, none).otherwise(0).alias("sources"))
    return told.withColumn("problems", problems(F.col("answer"), F.col("sources"), F.col("answered")))
