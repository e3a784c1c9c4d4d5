"""Numeric and array expressions (MTH-*, JSN-*, HSH-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """MTH-01: scaled to length 1; the length counts as 1e-12 at least."""
    scaled = lambda n: F.transform(v, lambda x: x.cast("double") / n)
    return F.get(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), scaled), F.lit(0))


def dot(a: Column, b: Column, size: int = 0) -> Column:
    """MTH-02. With the vectors' ``size`` given, as one sum that Spark compiles."""
    if size:
        total = F.lit(0.0)
        for i in range(size):
            total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """MTH-03: one term's share of the score; higher is better."""
    idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def rrf(rank: Column, k: int = 60) -> Column:
    """MTH-04: one list's share."""
    return F.lit(1.0) / (k + rank)


def page_window(total: Column, start: Column, most: Column, end: Column) -> Column:
    """MTH-05: pages from ``start`` up to the tightest bound; empty past the end."""
    last = F.least(total, end, start + most - 1)
    bad = (start < 1) | (most < 1) | (end < start) | (total < 0)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("bad page window"))).when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def spread_positions(start: Column, n: Column, k: int) -> Column:
    """``k`` (two at least) evenly spaced ones of ``n`` numbers from ``start``, both ends included, all if there are no more; halves round to even. No list of all is made."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (start + F.bround(i * (n - 1) / (k - 1))).cast("int"))
    return F.when(n <= k, F.sequence(start, start + n - 1)).otherwise(F.array_distinct(picked))


def sample_positions(pages: Column, k: int) -> Column:
    """MTH-06: ``k`` evenly spaced elements, both ends included; halves round to even."""
    if k == 1:
        return F.slice(pages, 1, 1)
    n = F.size(pages)
    return F.when(n > 0, F.transform(spread_positions(F.lit(0), n, k), lambda i: F.get(pages, i))).otherwise(pages)


def is_glued(chars: Column, words: Column) -> Column:
    """MTH-08."""
    return (chars >= 180) & (words < 40) & ((words == 0) | (chars > 25 * words))


def text_layer(chars: Column, words: Column) -> Column:
    """MTH-09."""
    return F.when(is_glued(chars, words), "glued").when(chars >= 180, "digital").when(chars <= 25, "scanned").otherwise("sparse")


def gap_estimate(window: Column, missing: Column, sampled: Column) -> Column:
    """MTH-10."""
    return F.when(sampled > 0, F.least(window, F.bround(window * missing / sampled).cast("long"))).otherwise(F.lit(0).cast("long"))


def threshold(answerable_min: Column, unanswerable_max: Column) -> Column:
    """MTH-11: (min_top_score, gap, separable)."""
    gap = answerable_min - unanswerable_max
    return F.struct(F.when(gap > 0, (answerable_min + unanswerable_max) / 2).otherwise(answerable_min).alias("min_top_score"), gap.alias("gap"), (gap > 0).alias("separable"))


def page_budget(t: Column) -> Column:
    """MTH-13: words for "no limit" give null."""
    v = F.lower(F.trim(F.coalesce(t, F.lit(""))))
    return F.when(v.isin("", "-", "0", "all", "todo", "none"), None).otherwise(v.try_cast("int"))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """MTH-14."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def gain(rank: Column) -> Column:
    """MTH-15: 1 / log2(rank + 1)."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_gain(relevant: Column, depth: int = 5) -> Column:
    return F.when(relevant < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(relevant.cast("int"), F.lit(depth))), F.lit(0.0), lambda s, r: s + gain(r)))


def minutes(seconds: Column) -> Column:
    """MTH-17: m:ss."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.pmod(F.floor(seconds), F.lit(60)).cast("int"))


def sorted_filter(m: Column) -> Column:
    """JSN-04: a map as k:v by key, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit(":"), F.element_at(m, k))), ",")


def word_code(word: Column) -> Column:
    """HSH-02: crc32 of a word."""
    return F.crc32(F.encode(word, "UTF-8"))


def hash_vector(words: Column, size: int = 64, code=word_code) -> Column:
    """HSH-02, RET-17: counts of the words' codes mod ``size`` (94 at most), scaled to length 1; a stand-in for a text model. No words: all 0.

    Codes become letters of one text, in which each letter is counted by its absence.
    """
    if not 0 < size <= 94:
        raise ValueError("size must be 1 to 94")
    letter = lambda k: F.char(k.cast("bigint") + 33)
    said = F.array_join(F.transform(words, lambda w: letter(code(w) % size)), "")
    counts = lambda t: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.length(t) - F.length(F.replace(t, letter(k), F.lit("")))).cast("double"))
    return F.get(F.transform(F.transform(F.array(said), counts), unit), F.lit(0))


def limit_or(t: Column, default: int) -> Column:
    """MTH-18: a limit as given, or the default where it is blank or no number."""
    return F.coalesce(t.try_cast("int"), F.lit(default))
