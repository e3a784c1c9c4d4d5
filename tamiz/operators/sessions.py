"""Tool sessions that may open only what they found: budgets, grants and replay (STM-03, RET-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.operators import audit

#: Calls of a session, and searches among them.
MOST_CALLS, MOST_SEARCHES = 6, 3
OUTCOMES = ("calls spent", "searches spent", "not found before", "no such passage", "done")


def outcomes(calls: DataFrame, returned: DataFrame, passages: DataFrame, by: str, step: Column, order: list[str], most_calls: int = MOST_CALLS, most_searches: int = MOST_SEARCHES) -> DataFrame:
    """``calls`` (``by``, ``order`` columns, kind, query, passage_id) with n_calls, n_searches and ``outcome``.

    ``returned`` (query, passage_id) is what a search gives, ``passages`` (passage_id) what exists. Calls that are refused count as well. A
    search within its budget grants what it returned, from then on; an ``open`` needs a grant before it, and a passage that exists. Other
    kinds only count. No session is folded: a session's first grant of each passage is the least place of a search that returned it,
    and opens are joined to it. ``step`` is as for ``audit.running``. Calls without a session are a session of their own.
    """
    placed = audit.running(calls, by, step, order, {"n_calls": F.lit(1), "n_searches": (F.col("kind") == "search").cast("int")})
    searches = placed.where((F.col("kind") == "search") & (F.col("n_calls") <= most_calls) & (F.col("n_searches") <= most_searches))
    grants = searches.select(F.col(by).alias("_by"), "query", "n_calls").join(returned.select("query", F.col("passage_id").alias("_id")), "query").groupBy("_by", "_id").agg(F.min("n_calls").alias("_granted"))
    known = passages.select(F.col("passage_id").alias("_known")).distinct()
    met = placed.join(grants, F.col(by).eqNullSafe(F.col("_by")) & (F.col("passage_id") == F.col("_id")), "left").join(known, F.col("passage_id") == F.col("_known"), "left")
    opens = F.col("kind") == "open"
    told = (
        F.when(F.col("n_calls") > most_calls, OUTCOMES[0]).when((F.col("kind") == "search") & (F.col("n_searches") > most_searches), OUTCOMES[1])
        .when(opens & ~F.coalesce(F.col("_granted") < F.col("n_calls"), F.lit(False)), OUTCOMES[2]).when(opens & F.col("_known").isNull(), OUTCOMES[3]).otherwise(OUTCOMES[4])
    )
    return met.withColumn("outcome", told).drop("_by", "_id", "_granted", "_known")


def opened(told: DataFrame, by: str) -> DataFrame:
    """(``by``, passage_id): what each session has opened, for the check of its drafts (CHK-09)."""
    return told.where(f"kind = 'open' and outcome = '{OUTCOMES[4]}'").select(by, "passage_id").distinct()


def replayed(recorded: DataFrame, told: DataFrame, by: str, order: list[str]) -> DataFrame:
    """RET-16: recorded calls (``by``, ``order``, kind, outcome) whose outcome is not what the rules give, with both; calls that only one side has, too."""
    keys = [by, *order]
    a, b = recorded.select(*keys, "kind", F.col("outcome").alias("recorded")), told.select(*keys, "kind", F.col("outcome").alias("expected"))
    return a.join(b, [*keys, "kind"], "full").where(~F.col("recorded").eqNullSafe(F.col("expected")))
