"""Documents made of pages: chunks across page breaks, document records, and evidence quotes (W1, W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import text


def offsets(pages: DataFrame, by: str, order: str, value: str, width: int = 1000) -> DataFrame:
    """``pages`` with ``start``, the sum of ``value`` over the rows of ``by`` that come before in ``order`` (a whole number), and ``total``.

    Sums are made per ``width`` steps of ``order`` first, so that no task sorts all rows of one large ``by``. Rows whose ``by`` is null go.
    """
    stepped = pages.where(F.col(by).isNotNull()).withColumn("_step", F.floor(F.col(order) / width))
    sums = stepped.groupBy(by, "_step").agg(F.sum(value).alias("_sum"))
    own = Window.partitionBy(by)
    before = sums.select(by, "_step", (F.sum("_sum").over(own.orderBy("_step")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(own).alias("total"))
    within = Window.partitionBy(by, "_step").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.join(before, [by, "_step"]).withColumn("start", F.col("_before") + F.sum(value).over(within) - F.col(value)).drop("_step", "_before")


def document_chunks(pages: DataFrame, size: int = 320, overlap: int = 45, least: int = 40) -> DataFrame:
    """RET-01, AGG-17: chunks of (document_id, page, text) whose words run across pages: document_id, ordinal, page_start, page_end, text.

    A page's words go to the chunks that they lie in, known from the words before the page, so only pieces of at most ``size`` words
    meet, never a document. (document_id, page) is unique; pages without words count for nothing.
    """
    step = size - overlap
    counted = pages.select("document_id", "page", text.words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("long")).where("n > 0")
    placed = offsets(counted, "document_id", "page", "n")
    a, n, total, k = F.col("start"), F.col("n"), F.col("total"), F.col("k")
    first = F.greatest(F.lit(0), F.ceil((a - size + 1) / step))
    last = F.least(F.floor((a + n - 1) / step), F.floor((total - least) / step))
    spread = placed.withColumn("k", F.explode(F.when((total >= least) & (last >= first), F.sequence(first, last)))).where((k == 0) | ((k - 1) * step + size < total))
    skip = F.greatest(k * step - a, F.lit(0))
    piece = F.slice("w", (skip + 1).cast("int"), (F.least(k * step + size - a, n) - skip).cast("int"))
    pieces = spread.select("document_id", k.alias("ordinal"), F.struct("page", piece.alias("w")).alias("piece"))
    met = pieces.groupBy("document_id", "ordinal").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = F.array_join(F.flatten(F.transform("pieces", lambda x: x["w"])), " ")
    return met.select("document_id", "ordinal", F.get("pieces", F.lit(0))["page"].alias("page_start"), F.element_at("pieces", -1)["page"].alias("page_end"), joined.alias("text"))


def document_records(chunks: DataFrame) -> DataFrame:
    """AGG-18: each document's chunks, those across a page break, and their characters."""
    crossing = (F.col("page_start") < F.col("page_end")).cast("long")
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(crossing).alias("crossing"), F.sum(F.length("text")).alias("characters"))


def evidence(results: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """RET-09, SRT-07: for each result (query_id, doc_id, rank) the passage's sentence with most of the query's terms; the first of equals.

    Sentences that state something (STR-13) go before the others. Quotes are clipped (STR-14), checked against the passage (STR-15) and
    numbered by rank: query_id, marker, doc_id, quote, grounded. Only the results' passages are split into sentences.
    """
    lowered = lambda c: F.transform(text.tokens(c), F.lower)
    terms = queries.select("query_id", F.filter(F.array_distinct(lowered(F.col("text"))), lambda w: F.length(w) > 2).alias("terms"))
    met = passages.select("doc_id", "text").join(results.select("query_id", "doc_id", "rank"), "doc_id").join(terms, "query_id")
    scored = F.transform(
        text.sentences(F.col("text")),
        lambda s, i: F.struct(text.is_evidence(s).alias("states"), F.size(F.array_intersect(F.col("terms"), lowered(s))).alias("score"), (-i).alias("order"), s.alias("s")),
    )
    best = met.withColumn("best", F.array_max(scored)).where("best is not null")
    quote = text.clip(F.col("best")["s"])
    marker = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return best.select("query_id", marker.alias("marker"), "doc_id", quote.alias("quote"), text.is_grounded(quote, F.col("text")).alias("grounded"))
