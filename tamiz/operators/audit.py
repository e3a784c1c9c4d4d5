"""Joins that say what they lose, constraint checks, ledgers and folds (W5, W6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_indicator(left: DataFrame, right: DataFrame, on: list[str], validate: bool = True) -> DataFrame:
    """JON-02, JON-03: all left rows with ``_merge`` (both, left_only); a right key that repeats is an error if ``validate``."""
    if validate and not right.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError("the right key is not unique")
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    return joined.withColumn("_merge", F.when(F.col("_there"), "both").otherwise("left_only")).drop("_there")


def rates(merged: DataFrame, by: list[str]) -> DataFrame:
    """AGG-01: rows, matched rows and their share per group."""
    hit = (F.col("_merge") == "both").cast("int")
    return merged.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(hit).alias("n_matched"), F.round(F.avg(hit), 6).alias("match_rate"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-06, CHK-01: keys that occur more than once, or are empty."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | empty)


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """WIN-05 for one key: the first row of each key in order; rows without a key all stay."""
    w = Window.partitionBy("_key").orderBy(*order)
    keyed = df.withColumn("_key", key)
    none = F.col("_key").isNull() | (F.col("_key") == "")
    return keyed.where(~none).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(keyed.where(none)).drop("_key")


def upsert(ledger: DataFrame, pending: DataFrame, on: list[str]) -> DataFrame:
    """STM-02: pending rows replace ledger rows of their key."""
    return ledger.join(pending, on, "left_anti").unionByName(pending)


def override(ledger: DataFrame, pending: DataFrame, on: list[str], allowed: Column | None = None) -> DataFrame:
    """JON-12, JON-13: full merge in which pending wins; with ``allowed`` (on ledger columns) only where it holds or the key is new."""
    rest = [c for c in ledger.columns if c not in on]
    a = ledger.select(*on, F.struct(*rest).alias("_l"), (F.lit(True) if allowed is None else allowed).alias("_ok"))
    b = pending.select(*on, F.struct(*rest).alias("_p"))
    best = F.when(F.col("_p").isNotNull() & (F.col("_l").isNull() | F.col("_ok")), F.col("_p")).otherwise(F.col("_l"))
    return a.join(b, on, "full").select(*on, best.alias("_x")).select(*on, "_x.*")


def upper_median(x: str) -> Column:
    """AGG-10: element n div 2 of the sorted values, counted from 0. State is a count per distinct value, made before the shuffle."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)")


def majority(df: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """AGG-11: the commonest label; ties go to the first in ``order``."""
    prio = F.coalesce(*[F.when(F.col(label) == x, -k) for k, x in enumerate(order)], F.lit(-len(order)))
    return df.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by(label, F.struct("n", prio)).alias(label), F.sum("n").alias("n"))


def _steps(rows: DataFrame, by: str, step: Column) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """``rows`` with ``_key`` (by, step), and the windows of a key's rows (order still to be given) and of the steps before one.

    ``step`` grows with the order of rows, so that what came before a step is known from one row per step, and no task sorts all rows of
    one large ``by``. Nulls in ``by`` are one group; null steps come first.
    """
    keyed = rows.withColumn("_key", F.struct(F.col(by).alias("of"), step.alias("step")))
    earlier = Window.partitionBy("_key.of").orderBy("_key.step").rowsBetween(Window.unboundedPreceding, -1)
    return keyed, Window.partitionBy("_key"), earlier


def _to_here(w: WindowSpec, order: list[str]) -> WindowSpec:
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(rows: DataFrame, by: str, step: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums over the rows of ``by`` up to each one in ``order``; null values are skipped, and a sum of none is null."""
    keyed, own, earlier = _steps(rows, by, step)
    keyed = keyed.withColumns({f"_of_{k}": v for k, v in sums.items()})
    per_step = keyed.groupBy("_key").agg(*[F.sum(f"_of_{k}").alias(f"_in_{k}") for k in sums])
    before = per_step.select("_key", *[F.sum(f"_in_{k}").over(earlier).alias(f"_before_{k}") for k in sums])
    within = keyed.withColumns({k: F.sum(f"_of_{k}").over(_to_here(own, order)) for k in sums})
    met = within.join(before, "_key").withColumns({k: F.coalesce(F.col(f"_before_{k}") + F.col(k), f"_before_{k}", k) for k in sums})
    return met.select(*rows.columns, *[k for k in sums if k not in rows.columns])


def budget(calls: DataFrame, by: str, step: Column, order: list[str], kind: Column, limits: dict[str, int], most: int) -> DataFrame:
    """STM-03: each call with its running numbers, and whether it is within the limits in all and per kind; refused calls count too.

    ``step`` is as for ``running``: a part of the order, such as the hour of its time.
    """
    out = running(calls, by, step, order, {"n_calls": F.lit(1), **{f"n_{k}": (kind == k).cast("int") for k in limits}})
    ok = F.col("n_calls") <= most
    for k, limit in limits.items():
        ok = ok & ((kind != k) | (F.col(f"n_{k}") <= limit))
    return out.withColumn("within", ok)


def changes(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """WIN-10: ``value`` less that of the row before, in ``order`` within ``by``; null for the first. For summed tables: the rows of one ``by`` are put in order by one task."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn(name, F.round(F.col(value) - before, 6))


def timeline(turns: DataFrame, by: str, order: str, duration: Column, pause: float = 0.4, width: int = 1000) -> DataFrame:
    """WIN-07: start and end of each turn, with a pause between turns. ``order`` is a number; sums are made per ``width`` of it first."""
    summed = running(turns, by, F.floor(F.col(order) / width), [order], {"_said": duration, "_turns": F.lit(1)})
    end = F.col("_said") + pause * (F.col("_turns") - 1)
    return summed.withColumns({"start_s": F.round(end - duration, 6), "end_s": F.round(end, 6)}).drop("_said", "_turns")


def forward_fill(lines: DataFrame, by: str, order: str, heading: Column, name: str, width: int = 1000) -> DataFrame:
    """WIN-08: the last heading at or before each line. ``order`` is a number; the last heading per ``width`` of it is found first."""
    keyed, own, earlier = _steps(lines, by, F.floor(F.col(order) / width))
    keyed = keyed.withColumn("_heading", heading)
    per_step = keyed.groupBy("_key").agg(F.max_by("_heading", F.when(F.col("_heading").isNotNull(), F.col(order))).alias("_last"))
    before = per_step.select("_key", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    within = keyed.withColumn("_within", F.last("_heading", ignorenulls=True).over(_to_here(own, [order])))
    return within.join(before, "_key").select(*lines.columns, F.coalesce("_within", "_before").alias(name))


def merge_report(left: DataFrame, merged: DataFrame, on: list[str], group: Column, more: str, less: str, coverage: float = 0.70, most: float = 0.85, gap: float = 0.15) -> DataFrame:
    """CHK-07: (rule, holds): rows kept, left key unique, coverage at least ``coverage`` and at most ``most``, and the rate of group ``more`` above that of ``less`` by ``gap``."""
    hit = F.col("_merge") == "both"
    rate = lambda x: F.avg(F.when(group == x, hit.cast("int")))
    found = merged.agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("rate"), (rate(more) - rate(less)).alias("gap"))
    rows, twice = left.agg(F.count("*").alias("rows")), duplicates(left, on).agg(F.count("*").alias("twice"))
    x = found.join(F.broadcast(rows)).join(F.broadcast(twice))
    rules = {"rows-kept": F.col("n") == F.col("rows"), "key-unique": F.col("twice") == 0, "coverage": F.col("rate") >= coverage, "rate-band": F.col("rate").between(coverage, most), "gap": F.col("gap") >= gap}
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("holds")) for k, v in rules.items()])).alias("r")).select("r.*")


def by_rate(rated: DataFrame, rate: str, then: str) -> DataFrame:
    """SRT-08: groups from the lowest rate up, ties by ``then``, with their place; there is a row per group only."""
    return rated.withColumn("place", F.row_number().over(Window.orderBy(rate, then))).orderBy("place")


def segments(parts: DataFrame, by: str, final: Column, pause: float = 0.4) -> DataFrame:
    """AGG-14, MTH-16: start and end of each group of (start_s, end_s), and the scale that takes its parts and pauses to ``final`` seconds."""
    said = F.sum(F.col("end_s") - F.col("start_s")) + pause * (F.count("*") - 1)
    return parts.groupBy(by).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"), F.round(final / said, 6).alias("scale"))


def same_sets(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """SET-04: (by, same): whether both have the same values for each ``by`` of ``a``; counted once each, however often they come."""
    both = a.select(by, value).distinct().withColumn("_a", F.lit(1)).join(b.select(by, value).distinct().withColumn("_b", F.lit(1)), [by, value], "full")
    return both.groupBy(by).agg((F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)) == 0).alias("same"))


def entry(listed: DataFrame, key: str, wanted: str) -> DataFrame:
    """RET-18: the entry of an id in any case."""
    return listed.where(F.upper(F.col(key)) == wanted.upper())
