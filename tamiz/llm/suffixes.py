"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes are sampled where content decides: of the first positions of each 200-byte window, the one whose 16 bytes have the least hash is
the window's anchor. Equal windows have their anchor at the same offset, and an anchor's suffix has its first ``HEAD`` bytes inside the
window, so two windows can only be equal if their anchors' suffixes have ``HEAD`` bytes in common. The windows that share an anchor are a
run of neighbours; a document has a run for every 75 bytes or so.

A suffix array has a row for each distinct head of the sampled suffixes: its first 16 bytes, by which the array is sorted, a fingerprint of
the whole head, one place (document and position), the number
of its runs, and whether they are of several kinds. A kind is a hash of all bytes of a
run. Documents come in batches. A batch's array is merge-scanned against the arrays of all levels so far, and where equal heads meet, the
head is a long match's; then levels of like size merge, so there are logarithmically many. Arrays are tables bucketed by head and sorted,
so scans and merges neither shuffle nor sort.

Runs of a head that has one kind only are equal throughout. Those of several kinds are compared at full length: kinds by their hash; where
they differ, one run of each kind in blocks of 16 windows, by a hash of the bytes that all of a block's windows share; and the windows of
such blocks one by one. Each step groups by hash and sums before it shuffles: a passage that is in a third of all documents is as cheap as
any, and no pairs are made.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, discard, new_folder, text_of
from tamiz.llm.filters import filter_of, some_rows

LENGTH, HEAD, BLOCK = 200, 48, 16
#: Bytes of a text whose windows are looked at together; positions in it fit in 24 bits.
SEGMENT = 1 << 23
_LOW = np.uint64((1 << 24) - 1)
_TOP = np.uint64(1 << 63)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SUFFIX = ("hi", "lo", "head")
#: What tells documents apart: a hash of doc_id and text, and the doc_id (null as 0).
DOC = ("doc", "own")


def _segment(text: bytes) -> tuple[np.ndarray, ...]:
    """Runs of windows by their anchor: first window, number of windows, anchor, and the suffix there: first 16 bytes, fingerprint of its head."""
    n, wide = len(text), LENGTH - HEAD + 1
    eights = np.ndarray((n - 7,), "<u8", text, 0, (1,))
    places = n - HEAD + 1
    h = eights[:places] * _ODD[0]
    h ^= eights[8 : 8 + places] * _ODD[1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = np.full(-(-places // wide) * wide, ~np.uint64(0))
    order[:places] = (h & ~_LOW) | np.arange(places, dtype=np.uint64)
    order = order.reshape(-1, wide)
    upto = np.minimum.accumulate(order, axis=1).ravel()
    since = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchors = (np.minimum(since[:windows], upto[wide - 1 : wide - 1 + windows]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    at = anchors[first]
    head = np.zeros(len(at), np.uint64)
    for j, odd in enumerate(_ODD):  # HEAD bytes, eight at a time
        head = (head ^ eights[at + 8 * j]) * odd
        head ^= head >> np.uint64(29)
    return first, np.diff(np.append(first, windows)), at, _ordered(eights[at]), _ordered(eights[at + 8]), head.view(np.int64)


def _ordered(words: np.ndarray) -> np.ndarray:
    """Eight bytes each as a number whose order is the bytes' order."""
    return (words.byteswap() ^ _TOP).view(np.int64)


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """``_segment`` over the whole text."""
    parts = []
    for at in range(0, len(text) - LENGTH + 1, SEGMENT):
        first, count, anchor, *suffix = _segment(text[at : at + SEGMENT + LENGTH - 1])
        parts.append((first + at, count, anchor + at, *suffix))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


_RUN = "hi long, lo long, head long, kind long, doc long, own long, first int, count int, anchor int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run of windows of (doc, own, text)."""
    for batch in batches:
        out, sizes = [], []
        for x in batch.column(2).cast(pa.binary()):
            text = x.as_py()
            first, count, anchor, hi, lo, head = runs(text)
            view = memoryview(text)
            kind = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)]
            out.append((hi, lo, head, _signed(kind), first.astype(np.int32), count.astype(np.int32), anchor.astype(np.int32)))
            sizes.append(len(first))
        if out:
            hi, lo, head, kind, *place = (np.concatenate(c) for c in zip(*out, strict=True))
            ids = [np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (hi, lo, head, kind, *ids, *place))], [x.split()[0] for x in _RUN.split(", ")])


def identified(docs: DataFrame, *more) -> DataFrame:
    """(doc, own, more..., text) of (doc_id, text): what tells a document from others, and its bytes."""
    return docs.select(F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("own"), *more, F.encode(text_of(docs), "UTF-8").alias("text"))


def sampled(docs: DataFrame) -> DataFrame:
    """The runs of windows of (doc_id, text), each with its anchor's suffix."""
    bound_batches(docs.sparkSession)
    return identified(docs).where(F.octet_length("text") >= LENGTH).mapInArrow(_runs, _RUN)


@dataclass
class Level:
    """One suffix array: the number of runs that it stands for, its table, and the table's folder."""

    size: int
    name: str
    path: str


class Family:
    """Levels of suffix arrays, largest first. ``add`` takes a new batch at any time; ``close`` deletes the arrays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, array: DataFrame) -> Level:
        name, path = f"suffixes_{uuid.uuid4().hex}", new_folder(self.spark, "suffixes")
        array.write.bucketBy(self.buckets, *SUFFIX).sortBy(*SUFFIX).option("path", path).saveAsTable(name)
        return Level(self.spark.table(name).agg(F.sum("n")).first()[0] or 0, name, path)

    def _drop(self, level: Level) -> None:
        self.spark.sql(f"DROP TABLE {level.name}")
        discard(self.spark, level.path)

    def _pair(self, new: DataFrame, level: Level, how: str) -> DataFrame:
        """Heads of both arrays, with ``n`` and ``several`` as of both together; the older place stays."""
        old = self.spark.table(level.name).select(*SUFFIX, *[F.col(c).alias(f"old_{c}") for c in ("kind", "n", "several", "own", "position")])
        both = F.col("kind").isNotNull() & F.col("old_kind").isNotNull()
        no = lambda c: F.coalesce(c, F.lit(False))
        none = lambda c: F.coalesce(c, F.lit(0))
        return new.join(old, list(SUFFIX), how).select(
            *SUFFIX, F.coalesce("old_kind", "kind").alias("kind"), (none("n") + none("old_n")).alias("n"),
            (no("several") | no("old_several") | (both & (F.col("kind") != F.col("old_kind")))).alias("several"), F.coalesce("old_own", "own").alias("own"), F.coalesce("old_position", "position").alias("position"),
        )

    def add(self, batch: DataFrame, found: str) -> None:
        """Give a batch's runs an array, and append the heads that it repeats, from itself or from a level, to the table at ``found``.

        ``several`` tells whether the runs of such a head differ. An empty batch leaves the levels as they are.
        """
        low, high = F.min("kind"), F.max("kind")
        made = batch.groupBy(*SUFFIX).agg(low.alias("kind"), F.count("*").alias("n"), (low != high).alias("several"), F.min("own").alias("own"), F.min_by("anchor", "own").alias("position"))
        level = self._write(made)
        new = self.spark.table(level.name)
        repeated = new.where("n > 1").select("head", "several")
        for old in self.levels:
            repeated = repeated.unionAll(self._pair(new, old, "inner").select("head", "several"))
        repeated.write.mode("append").parquet(found)
        self.levels.append(level)
        if not level.size:
            self._drop(self.levels.pop())
        while len(self.levels) > 1 and 2 * self.levels[-2].size < 3 * self.levels[-1].size:
            new, old = self.levels.pop(), self.levels.pop()
            self.levels.append(self._write(self._pair(self.spark.table(new.name), old, "full")))
            self._drop(new)
            self._drop(old)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of windows by their offset to the anchor: hash of what they share, hash of all, place."""
    for batch in batches:
        out = []
        for doc, own, x, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            text = memoryview(x.as_py())
            for place in places.as_py():
                first, count, anchor = place["a"], place["b"], place["c"]
                far, near = anchor - first, anchor - first - count + 1
                for q in range(near // BLOCK, far // BLOCK + 1):
                    lo, hi = max(q * BLOCK, near), min(q * BLOCK + BLOCK - 1, far)
                    core = xxhash.xxh3_64_intdigest(text[anchor - q * BLOCK : anchor - q * BLOCK - BLOCK + 1 + LENGTH], q)
                    full = xxhash.xxh3_64_intdigest(text[anchor - hi : anchor - lo + LENGTH], lo * 256 + hi)
                    out.append((doc, own, core, full, anchor - hi, hi - lo + 1))
        doc, own, core, full, first, count = zip(*out, strict=True) if out else ((),) * 6
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(_signed(core)), pa.array(_signed(full)), pa.array(first, pa.int64()), pa.array(count, pa.int64())], ["doc", "own", "core", "full", "first", "count"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the blocks that need it: the block's hash, the window's, place."""
    for batch in batches:
        out = []
        for doc, own, x, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            text = memoryview(x.as_py())
            for place in places.as_py():
                out += [(doc, own, place["c"], xxhash.xxh3_64_intdigest(text[p : p + LENGTH]), p) for p in range(place["a"], place["a"] + place["b"])]
        doc, own, core, window, first = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(core, pa.int64()), pa.array(_signed(window)), pa.array(first, pa.int64())], ["doc", "own", "core", "window", "first"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one each."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, x, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = x.as_py()
                spans = merge_spans([(p["a"], p["b"]) for p in places.as_py() or ()])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names)

    return remove


class _Scratch:
    """Tables in the shared folder, which are deleted when no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = new_folder(self.spark, name)
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))


def remove_repeats(docs: DataFrame, batches: int = 4, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for).

    Every byte is removed that lies in a 200-byte string which also starts elsewhere, in the same or another document. Matches do not cross
    documents; all are judged on the input. A null text is empty; texts under 200 bytes are kept whole; repeated rows are copies of each
    other; a null doc_id is like any other; an empty table gives no rows. Further columns are not read.

    Documents go into ``batches`` of about equal bytes, by a hash, which are added to a ``Family`` one after another. A batch is merge-scanned
    against all that came before, so a whole table is best taken in few batches, however large.
    """
    spark, scratch = docs.sparkSession, _Scratch(docs.sparkSession)
    # shuffle files of finished jobs go at once; tables that are sorted by bucket are known to be
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return _remove_repeats(docs, batches, with_text, scratch)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _remove_repeats(docs: DataFrame, batches: int, with_text: bool, scratch: _Scratch) -> DataFrame:
    spark = docs.sparkSession
    run = scratch.put("runs", sampled(docs))

    # the family of suffix arrays finds heads that repeat
    family, found = Family(spark), new_folder(spark, "found")
    for k in range(batches):
        family.add(run.where(F.pmod("doc", F.lit(batches)) == k), found)
    family.close()
    heads = spark.read.schema("head long, several boolean").parquet(found).groupBy("head").agg(F.max("several").alias("several"))
    met = scratch.put("met", run.select("head", "kind", *DOC, "first", "count", "anchor").join(scratch.put("heads", heads).select("head", "several"), "head"))
    discard(spark, found)
    scratch.drop("runs", "heads")
    end = (F.col("first") + F.col("count") + LENGTH - 1).alias("b")
    spans = [met.where("not several").select(*DOC, F.col("first").alias("a"), end)]

    # where runs with one head differ: by all their bytes
    differ = met.where("several")
    place = F.xxhash64(*DOC, "first")
    one = [F.min_by(c, place).alias(c) for c in (*DOC, "first", "count", "anchor")]
    kinds = scratch.put("kinds", differ.groupBy("head", "kind").agg(F.count("*").alias("n"), *one))
    twice = scratch.put("twice", kinds.where("n > 1").select("head", "kind"))
    spans.append(scratch.put("equal", differ.join(twice, ["head", "kind"]).select(*DOC, F.col("first").alias("a"), end)))
    scratch.drop("twice")
    return _finish(docs, scratch, spans, kinds, with_text)


def _of_docs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, own, text, places) of the documents that have places (doc, own, a, b, c); no others are shuffled."""
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(filter_of(places.select(F.col("doc").alias("key")).distinct()))
    some = identified(docs).mapInArrow(some_rows(marks, True), "doc long, own long, text binary")
    per = places.groupBy(*DOC).agg(F.collect_set(F.struct("a", "b", "c")).alias("places"))  # bounded by a document's length
    return some.join(per, list(DOC)).select(*DOC, "text", "places")


def _finish(docs: DataFrame, scratch: _Scratch, spans: list[DataFrame], kinds: DataFrame, with_text: bool) -> DataFrame:
    # a run of each kind, in blocks of windows
    spark, ids = docs.sparkSession, "doc long, own long"
    places = kinds.select(*DOC, F.col("first").alias("a"), F.col("count").alias("b"), F.col("anchor").alias("c"))
    block = scratch.put("blocks", _of_docs(docs, places).mapInArrow(_blocks, f"{ids}, core long, full long, first long, count long"))
    scratch.drop("kinds")
    cores = scratch.put("cores", block.groupBy("core").agg(F.count("*").alias("n"), F.min("full").alias("lo"), F.max("full").alias("hi")).where("n > 1").select("core", (F.col("lo") == F.col("hi")).alias("same")))
    met = scratch.put("cored", block.join(cores, "core").select(*DOC, "core", "first", "count", "same"))
    scratch.drop("blocks", "cores")
    spans.append(met.where("same").select(*DOC, F.col("first").alias("a"), (F.col("first") + F.col("count") + LENGTH - 1).alias("b")))

    # windows one by one, where blocks share some bytes but not all
    places = met.where("not same").select(*DOC, F.col("first").alias("a"), F.col("count").alias("b"), F.col("core").alias("c"))
    window = scratch.put("windows", _of_docs(docs, places).mapInArrow(_single, f"{ids}, core long, window long, first long"))
    again = scratch.put("again", window.groupBy("core", "window").agg(F.count("*").alias("n")).where("n > 1").select("core", "window"))
    spans.append(scratch.put("single", window.join(again, ["core", "window"]).select(*DOC, F.col("first").alias("a"), (F.col("first") + LENGTH).alias("b"))))
    scratch.drop("windows", "again")

    every = spans[0].select(*DOC, F.col("a").cast("long"), F.col("b").cast("long"))
    for part in spans[1:]:
        every = every.unionAll(part)
    per = scratch.put("spans", every.groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("places")))
    scratch.drop("met", "equal", "cored", "single")
    marks = spark.sparkContext.broadcast(filter_of(per.select(F.col("doc").alias("key"))))
    named = identified(docs, F.col("doc_id").cast("long").alias("doc_id"))
    schema = f"{ids}, doc_id long, text binary"
    some = named.mapInArrow(some_rows(marks, True), schema).join(per, list(DOC), "left").select("doc_id", "text", "places")
    rest = named.mapInArrow(some_rows(marks, False), schema)
    whole = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_text)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return some.mapInArrow(_removed(with_text), out).unionAll(whole)
