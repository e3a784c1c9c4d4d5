"""Quality rules with thresholds that adapt to each language and source.

Fixed base rules reject what is too short or repeats itself. Beyond them, each ratio of a document is held against fences from the
distribution of its (language, source): quartiles, or a high quantile of ratios that are mostly zero, come from quantile sketches, which are counts over logarithmic buckets. Sketches of
parts of the data merge by adding counts, in any order, to the same result, and a quantile is exact to ``accuracy``, relative to its value.
The thresholds are then joined to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, cut, numbered, settled

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INNER = np.array([128 <= c < 192 for c in range(256)])  # continuation bytes: no code point starts there
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _repeated(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that are found twice or more, told apart by 64-bit mixes of word numbers."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    mixed = codes * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for k in range(size):
        keys = keys * _FACTORS[0] + mixed[k : k + n] * _FACTORS[k]
        keys ^= keys >> np.uint64(31)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    np.add.at(twice, at, 1)
    np.add.at(twice, at + size, -1)
    return int((np.cumsum(twice) > 0).sum())


def measures_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0
    seen: set[bytes] = set()
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int((_SPACE[raw] | _INNER[raw]).sum())
    return len(words), chars, int(_SYMBOL[raw].sum()), dup, _repeated(words)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTS = (*_NAMES, "n_lines")
#: Ratios that are mostly zero are held against this quantile of their group's documents that pass the base rules, within these bounds.
TAIL, TAILS = 0.95, {"symbols": (0.05, 0.2), "repeats": (0.05, 0.2), "dup_lines": (0.1, 0.3)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(3).cast(pa.binary())]
        rows = [(*measures_of(x), sum(1 for line in x.split(b"\n") if line.strip())) for x in texts]
        columns = np.array(rows, np.int64).reshape(-1, len(_COUNTS)).T
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns)], ["doc_id", "lang", "source", *_COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts and the non-blank lines of each whole text; a null text has none of anything."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in _COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(_measure, schema)


def ratios(lines: bool = True) -> dict[str, Column]:
    """What the fences are on; each is 0 for ordinary prose or moves little about its median. dup_lines needs the count of ``lines``."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    found = {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }
    return found | {"dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))} if lines else found


def sketches(found: DataFrame, by: tuple[str, ...], accuracy: float = 0.01, shards: int = 16) -> DataFrame:
    """Quantile sketches: (by..., name, bucket, n). Counts are summed before rows are shuffled, so a hot group is as cheap as any.

    Bucket k holds values in (g^(k-1), g^k], g = (1 + accuracy) / (1 - accuracy); a value of 0 has the least bucket.
    """
    growth = math.log((1 + accuracy) / (1 - accuracy))
    bucket = lambda x: F.when(x > 0, F.ceil(F.log(x) / growth).cast("int")).otherwise(F.lit(-(1 << 30)))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), bucket(x).alias("bucket")) for k, x in ratios("n_lines" in found.columns).items()]))
    return found.select(*by, values.alias("v")).groupBy(*by, "v.name", "v.bucket").agg(F.count("*").alias("n"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of parts of the data as one."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*[c for c in every.columns if c != "n"]).agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: tuple[str, ...], points: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: float = 0.01) -> DataFrame:
    """(by..., name, total, q0, q1, ...): the value at each point. A sketch has few rows: its buckets."""
    growth = (1 + accuracy) / (1 - accuracy)
    group = Window.partitionBy(*by, "name")
    up = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    value = F.when(F.col("bucket") == -(1 << 30), F.lit(0.0)).otherwise(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1))
    return up.groupBy(*by, "name").agg(F.first("total").alias("total"), *[F.min(F.when(F.col("upto") >= p * F.col("total"), value)).alias(f"q{k}") for k, p in enumerate(points)])


def _failed(least_words: int, most_repeated: float) -> Column:
    """The base rules."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def fences(docs_measures: DataFrame, by: tuple[str, ...] = ("lang", "source"), reach: float = 4.0, prior: float = 30.0, least_words: int = 10, most_repeated: float = 20.0) -> DataFrame:
    """A row per group with a lower and an upper fence of each ratio, from its documents that pass the base rules.

    word_length: quartiles moved out by ``reach`` times their distance, which counts as a tenth of the median at least, or 0.05, so that a
    group of near-equal documents isn't thinned. The others are mostly zero, and so are their quartiles: at most their ``TAIL`` quantile,
    kept within the bounds of ``TAILS``, so that a group of clean texts allows for some and one of much junk doesn't admit it. A group's
    quantiles are blended with those of all documents as if it had ``prior`` more of these, so small groups lean on the whole and large ones
    on themselves, without a size at which that changes; ``own_weight`` is the group's part. Null lang or source is a group of its own.
    """
    filled = docs_measures.where(~_failed(max(least_words, 1), most_repeated)).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in by], *_COUNTS)
    sketch = cut(sketches(filled, by), "sketches")
    points, accuracy = (0.25, 0.5, 0.75, TAIL), 0.01  # the upper end of a bucket is its value / (1 - accuracy)
    every = quantiles(sketch.groupBy("name", "bucket").agg(F.sum("n").alias("n")), (), points)
    own = quantiles(sketch, by, points)
    joined = own.join(F.broadcast(every.select("name", *[F.col(f"q{k}").alias(f"all{k}") for k in range(4)])), "name")
    weight = F.col("total") / (F.col("total") + F.lit(prior))
    low, mid, high, tail = (weight * F.col(f"q{k}") + (1 - weight) * F.col(f"all{k}") for k in range(4))
    wide = F.greatest(high - low, 0.1 * mid, F.lit(0.05))
    lower, upper = low - reach * wide, high + reach * wide
    for name, (floor, most) in TAILS.items():
        lower = F.when(F.col("name") == name, 0.0).otherwise(lower)
        upper = F.when(F.col("name") == name, F.least(F.greatest(tail / (1 - accuracy), F.lit(floor)), F.lit(most))).otherwise(upper)
    joined = joined.select(*by, "name", weight.alias("own"), lower.alias("lower"), upper.alias("upper"))
    return joined.groupBy(*by).agg(F.round(F.min("own"), 6).alias("own_weight"), *[F.max(F.when(F.col("name") == k, F.col(side))).alias(f"{k}_{side}") for k in ratios() for side in ("lower", "upper")])


def judged(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), least_words: int = 10, most_repeated: float = 20.0, reach: float = 4.0) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, kept: passes the base rules and lies within its group's fences, and own_weight:
    the group's own part in those, the rest is of all documents (null if all of the group fail the base rules).

    base_failed: under ``least_words`` words, or more than ``most_repeated`` percent of words in repeated windows. Null, empty and blank
    texts fail. Repeated rows are judged each. An empty table gives an empty result. Further columns are not read.
    """
    found = cut(measures(docs), "measures")
    limits = settled("fences", lambda: fences(found, by, reach, least_words=least_words, most_repeated=most_repeated))
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in by]
    # a few figures per group; the documents' side is only counts, and a hot group's rows are dealt by skew handling
    joined = found.select("*", *keys).join(limits.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in limits.columns if c not in by]), [f"_{c}" for c in by], "left")
    inside = F.lit(True)
    for name, value in ratios().items():
        inside = inside & F.coalesce(value.between(F.col(f"{name}_lower"), F.col(f"{name}_upper")), F.lit(True))
    failed = _failed(least_words, most_repeated)
    return joined.select("doc_id", "lang", "source", *_NAMES, failed.alias("base_failed"), (~failed & inside).alias("kept"), "own_weight")


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` that ``judged`` keeps, all columns unchanged. Rows go by a number of their own, so a doc_id may be null or repeated."""
    rows, row = numbered(docs)
    by = settings.get("by", ("lang", "source"))
    own = rows.select(F.col(row).alias("doc_id"), "text", *{"lang": 0, "source": 0} | dict.fromkeys(by))
    good = settled("good", lambda: judged(own, **settings).where("kept").select(F.col("doc_id").alias(row)))
    return rows.join(good, row, "left_semi").select(*docs.columns)
