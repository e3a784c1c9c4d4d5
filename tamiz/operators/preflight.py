"""What documents' text layers are worth before an index is built, pages still to be recognised, and repair of paths (W1, RET-14, RET-15)."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import numbers, text
from tamiz.session import written

#: Page layers in the order in which ties are settled.
LAYERS = ("scanned", "glued", "sparse")


def page_text(policy: Column, embedded: Column, ocr: Column, least: int = 200, glued_aware: bool = False) -> Column:
    """FLT-04: the embedded text for ``digital``, and for ``auto`` if it has ``least`` characters (and isn't glued, if asked); else the longer one, the embedded of equals."""
    own, seen = F.coalesce(embedded, F.lit("")), F.coalesce(ocr, F.lit(""))
    enough = F.length(own) >= least
    if glued_aware:
        enough = enough & ~numbers.is_glued(F.length(own), text.word_count(own))
    return F.when((policy == "digital") | ((policy == "auto") & enough), own).when(F.length(seen) > F.length(own), seen).otherwise(own)


def scope(layer: Column, missing: Column) -> Column:
    """FLT-05: whether missing pages are a bill (full-scan), a bound (mixed-gaps) or none."""
    bad = F.raise_error(F.concat(F.lit("unknown text layer: "), layer))
    return F.when((missing == 0) | layer.isNull() | (layer == "digital"), "none").when(layer.isin(*LAYERS), "full-scan").when(layer == "mixed", "mixed-gaps").otherwise(bad)


def inspect(manifest: DataFrame, pages: DataFrame, cached: DataFrame, sample: int = 7) -> DataFrame:
    """RET-14: one report per document of (document_id, start_page, end_page, max_pages, state), over pages (document_id, page, text) and recognised ones (document_id, page).

    ``state`` is null, missing, encrypted or damaged. Windows are ranges, so the sampled pages come from arithmetic and only they are read
    as text; counts per document are made before any shuffle. Layers: all digital, mixed if some are, else the commonest.
    """
    if sample < 2:
        raise ValueError("sample must be 2 at least")
    totals = pages.groupBy("document_id").agg(F.max("page").cast("int").alias("total_pages"))
    start = F.col("start_page")
    ranged = (
        manifest.select("document_id", F.col("start_page").cast("int"), F.col("end_page").cast("int"), F.col("max_pages").cast("int"), "state").join(totals, "document_id", "left")
        .withColumn("last", F.least("total_pages", "end_page", start + F.col("max_pages") - 1)).withColumn("window_pages", F.when(F.col("state").isNull(), F.greatest(F.coalesce(F.col("last") - start + 1, F.lit(0)), F.lit(0))).otherwise(0))
    )
    n = F.col("window_pages")
    windows = ranged.withColumn("sampled_pages", F.when(n == 0, F.array().cast("array<int>")).otherwise(numbers.spread_positions(start, n, sample)))
    asked = windows.select("document_id", F.explode("sampled_pages").alias("page"))
    t = text.normalize(F.coalesce("text", F.lit("")))
    met = pages.join(asked, ["document_id", "page"]).select("document_id", F.length(t).alias("c"), text.word_count(t).alias("w")).withColumn("l", numbers.text_layer(F.col("c"), F.col("w")))
    of = lambda x: F.count(F.when(F.col("l") == x, 1))
    found = met.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum("w").alias("words"), of("digital").alias("digital"), *[of(x).alias(x) for x in LAYERS])
    common = F.array_max(F.array(*[F.struct(F.col(x).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("l")) for k, x in enumerate(LAYERS)]))["l"]
    layer = F.when(F.col("digital") == F.col("n"), "digital").when(F.col("digital") > 0, "mixed").otherwise(common)
    inside = cached.select("document_id", "page").distinct().join(windows.where("window_pages > 0").select("document_id", "start_page", "last"), "document_id").where("page between start_page and last")
    done = inside.groupBy("document_id").agg(F.count("*").cast("int").alias("covered"))
    joined = windows.join(found, "document_id", "left").join(done, "document_id", "left").withColumn("text_layer", F.when(F.col("n").isNotNull(), layer))
    missing = F.when(F.col("text_layer") != "digital", n - F.coalesce("covered", F.lit(0))).otherwise(0)
    scoped = joined.withColumn("ocr_missing_pages", missing).withColumn("ocr_scope", scope(F.col("text_layer"), F.col("ocr_missing_pages"))).withColumn("sampled_without_text", F.coalesce(F.col("n") - F.col("digital"), F.lit(0)))
    estimate = numbers.gap_estimate(n, F.col("sampled_without_text"), F.size("sampled_pages"))
    bill = F.when(F.col("ocr_scope") == "full-scan", F.col("ocr_missing_pages").cast("long")).when(F.col("ocr_scope") == "mixed-gaps", F.least(F.col("ocr_missing_pages").cast("long"), estimate)).otherwise(F.lit(0).cast("long"))
    clean = (F.col("text_layer") == "digital") | ((F.col("covered") > 0) & (F.col("ocr_missing_pages") == 0))
    status = F.when(F.col("state").isNotNull(), F.col("state")).when(n == 0, "empty-window").when(clean, "ok").otherwise("needs-ocr")
    return scoped.select(
        "document_id", status.alias("status"), "total_pages", "window_pages", "sampled_pages", F.round(F.col("chars") / F.col("n"), 1).alias("chars_per_page"), F.round(F.col("words") / F.col("n"), 1).alias("words_per_page"),
        "text_layer", "sampled_without_text", F.coalesce("glued", F.lit(0)).alias("sampled_glued"), F.coalesce("covered", F.lit(0)).alias("ocr_cached_pages"), "ocr_missing_pages", "ocr_scope", bill.alias("ocr_pages_estimate"),
    )


def debt(reports: DataFrame) -> DataFrame:
    """AGG-08: pages to be recognised: the bill and the bound with its estimate, never added."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("ocr_scope") == kind, F.col(c))), F.lit(0)).cast("long")
    return reports.agg(of("full-scan", "ocr_missing_pages").alias("full_scan"), of("mixed-gaps", "ocr_missing_pages").alias("mixed_upper_bound"), of("mixed-gaps", "ocr_pages_estimate").alias("mixed_estimate"))


def outstanding(windows: DataFrame, cached: DataFrame, most: int | None = None) -> DataFrame:
    """RET-15: (document_id, page) still to be recognised of windows (document_id, start_page, last), at most the first ``most`` of a document."""
    asked = windows.where("last >= start_page").select("document_id", F.explode(F.sequence("start_page", "last")).alias("page")).join(cached.select("document_id", "page"), ["document_id", "page"], "left_anti")
    if most is None:
        return asked
    return asked.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("page"))).where(F.col("_n") <= most).drop("_n")


#: Known and asked texts of a block, cells of the matrix that a block's texts of similar length make, known texts that are sent to all tasks.
KNOWN, ASKED, CELLS, SENT = 16384, 32, 1 << 22, 200_000


def _matrices(texts: list[str], cells: int):
    """(numbers, lengths, code points by position) of some of the texts after another, of similar lengths, so that a long one doesn't widen all."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(texts[order[end]]) * (end + 1 - at) <= cells:
            end += 1
        own = [texts[k] for k in order[at:end]]
        width = len(own[-1])
        codes = np.array(own, f"<U{max(width, 1)}").view(np.uint32).reshape(len(own), max(width, 1))[:, :width].T
        yield np.array(order[at:end]), np.array([len(t) for t in own]), np.ascontiguousarray(codes)
        at = end


def _in_order(a: str, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many characters, at most, ``a`` shares with each text of a matrix in the same order: the longest common subsequence by bits, of 64 characters of ``a`` at a time."""
    most = np.full(codes.shape[1], a.count("\x00"), np.int64)  # a matrix is padded with it
    for at in range(0, len(a), 64):
        piece = [ord(c) for c in a[at : at + 64]]
        for k, c in enumerate(piece):
            if c:
                table[c] |= np.uint64(1 << k)
        left = np.full(codes.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
        for row in codes:
            met = left & table[row]
            left = (left + met) | (left - met)
        most += 64 - np.bitwise_count(left).astype(np.int64)
        table[piece] = 0
    return most


def candidates(asked: DataFrame, known: DataFrame, least: float, top: int) -> DataFrame:
    """(document_id, path, a, b, ratio): the pairs of asked (document_id, a) and known (path, b) texts that may be among the ``top`` of an asked one, and reach ``least``.

    Twice the matched characters over all is a pair's likeness, as a sequence matcher finds them; matched ones stand in the same order in both
    texts, so it is at most what the longest common subsequence gives, which is found for a block of known texts at once. The matcher runs on
    pairs in the order of that bound, until it stays under the ``top``-th likeness that the task has found. Equal texts are compared once.
    """
    kinds = dict(known.dtypes)
    own = Window.partitionBy("b").orderBy("path")
    some = known.select("path", "b").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= top).drop("_n").repartition(-(-known.count() // KNOWN) or 1)
    texts = asked.select("a").distinct()
    questions = texts.repartition(-(-texts.count() // ASKED) or 1)

    def packed(names, rows):
        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in names], names)

        return pack

    def compare(batches):
        table, best = np.zeros(0x110000, np.uint64), {}
        matcher = SequenceMatcher(None)
        for batch in batches:
            for texts_, paths, others in zip(batch["as"].to_pylist(), batch["paths"], batch["bs"].to_pylist(), strict=True):
                if len(best) > 100 * ASKED:
                    best = {}
                told = []
                for numbers_, lengths, codes in _matrices(others, CELLS):
                    for a in texts_:
                        matcher.set_seq1(a)
                        firsts = best.setdefault(a, [])
                        bar = lambda: max(least, firsts[0] if len(firsts) == top else least)  # noqa: B023, E731
                        total = lengths + len(a)
                        bound = np.where(total > 0, 2.0 * _in_order(a, codes, table) / np.maximum(total, 1), 1.0)
                        undone = np.ones(len(bound), bool)
                        while len(left := np.flatnonzero(undone & (bound >= bar()))):
                            if len(left) > 64:
                                left = left[np.argpartition(-bound[left], 64)[:64]]
                            undone[left] = False
                            for k in left[np.argsort(-bound[left], kind="stable")].tolist():
                                if bound[k] < bar():
                                    break
                                b = others[numbers_[k]]
                                matcher.set_seq2(b)
                                ratio = matcher.ratio()
                                if ratio >= bar():
                                    told.append((a, numbers_[k], b, ratio))
                                    (heapq.heappushpop if len(firsts) == top else heapq.heappush)(firsts, ratio)
                kept = [t for t in told if len(best[t[0]]) < top or t[3] >= best[t[0]][0]]
                columns = list(zip(*kept, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), paths.values.take(pa.array(columns[1], pa.int64())), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())], ["a", "path", "b", "ratio"])

    held = some.mapInArrow(packed(["path", "b"], KNOWN), f"path array<{kinds['path']}>, b array<string>").select(F.col("path").alias("paths"), F.col("b").alias("bs"))
    lists = questions.mapInArrow(packed(["a"], ASKED), "a array<string>").select(F.col("a").alias("as"))
    held = written(held, "known")
    met = lists.crossJoin(F.broadcast(held) if known.count() <= SENT else held).mapInArrow(compare, f"a string, path {kinds['path']}, b string, ratio double")
    return met.join(asked, "a").select("document_id", "path", "a", "b", "ratio")


def suggestions(missing: DataFrame, catalogue: DataFrame, least: float = 0.0, top: int = 3) -> DataFrame:
    """STR-30, JON-10, SRT-05: for each missing (document_id, relative_path) the ``top`` paths of ``catalogue`` (path) by likeness of their keys, ties by path.

    The rows are those of a comparison of all pairs, of which ``candidates`` leaves most out. Paths that the catalogue repeats count once.
    """
    asked = missing.select("document_id", text.match_key(F.col("relative_path")).alias("a")).where("a is not null")
    known = catalogue.select("path", text.match_key(F.col("path")).alias("b")).where("path is not null").distinct()
    order = Window.partitionBy("document_id").orderBy(F.desc("ratio"), "path")
    return candidates(asked, known, least, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("document_id", "path", "ratio", "rank")


def fixes(suggested: DataFrame, least: float = 0.72, margin: float = 0.05) -> DataFrame:
    """FLT-06, WIN-09: the best suggestion of each document if it is alike enough and well before the next; ratios to three digits."""
    ratio = F.round("ratio", 3)
    after = F.lead(ratio, 1, 0.0).over(Window.partitionBy("document_id").orderBy("rank"))
    ahead = suggested.withColumn("next", after).where("rank = 1").where((ratio >= least) & (F.round(ratio - F.col("next"), 9) >= margin))
    return ahead.select("document_id", F.col("path").alias("to"), ratio.alias("ratio"))
