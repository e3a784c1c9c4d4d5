"""Alignment of two tokenizers' tokens by the bytes of the text that they cover.

The work on tokens is done on Arrow columns: the ids of a block of documents are one list column, flattened with each token's document
beside it; ends in bytes are cumulative sums that start anew in each document; ends that both tokenizers share are found by a hash join on
(document, end). They cut the document into groups, and the two tokens that end there are linked. Links are counted by pair of ids within
the block, and Spark adds the blocks' counts. Then each block gets the counts of its own pairs back, not one row per link.
"""

from __future__ import annotations

import hashlib
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, cut
from tamiz.llm.packing import _ODD_SPACE, encoder

BLOCK = "block long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pair_a array<int>, pair_b array<int>, pair_n array<long>"


class Bytes:
    """Byte-level BPE: the ids of a text with a space before it, and the bytes of each id. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.own = encoder(path)
        if not self.own.plain:
            raise ValueError(f"{path} is no plain byte-level BPE")
        ranks = self.own.fast.__self__._mergeable_ranks
        raw = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            raw[k] = token
        self.raw = pa.array(raw, pa.binary())

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self._ids(" " + t), np.uint32) for t in texts]

    def _ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return array("I", self.own.fast(text)).tobytes()
        first, *rest = text.split(" ")
        return b"".join([array("I", self.own.fast(first)).tobytes(), *map(self.own.pieces.__getitem__, rest)])


class Pieces:
    """SentencePiece: the ids of a text, before which it sets a space itself, and the bytes of each id: its piece with U+2581 as space, or the byte that it names."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        said = [own.id_to_piece(k) for k in range(own.get_piece_size())]
        self.raw = pa.array([bytes([int(p[3:5], 16)]) if own.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(said)], pa.binary())
        self.own = own

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.own.encode(texts, num_threads=1)]


def _loaded(kind: type, path: str):
    """One of each tokenizer in a Python worker."""
    held = sys.modules.setdefault("_tamiz_aligners", types.ModuleType("_tamiz_aligners")).__dict__
    if (kind.__name__, path) not in held:
        held[kind.__name__, path] = kind(path)
    return held[kind.__name__, path]


def _bytes_of(raw: pa.Array, ids: pa.Array) -> memoryview:
    """The tokens' bytes, one after another."""
    found = raw.take(ids)
    data = found.buffers()[2]
    return memoryview(data or b"").cast("B")


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.uint32)).cast(pa.int32()))


def _ended(lists: pa.ListArray, raw: pa.Array) -> pa.Table:
    """(doc, end, id, place): a token's document, where it ends in its bytes, and its place among all."""
    ids, docs = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.binary_length(raw.take(ids)).cast(pa.int64()))
    sums = pa.concat_arrays([pa.array([0], pa.int64()), total])
    before = sums.take(lists.offsets.slice(0, len(lists)))  # the sum at each document's start
    return pa.table({"doc": docs, "end": pc.subtract(total, before.take(docs)), "id": ids, "place": pa.array(np.arange(len(ids)))})


def _valid(texts: list[bytes | None], ids: list[np.ndarray], raw: pa.Array) -> list[bool]:
    """Whether a text's tokens have just its bytes, with a space before."""
    lists = _lists(ids)
    flat = pc.list_flatten(lists)
    data = _bytes_of(raw, flat)
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(raw.take(flat)).to_numpy(zero_copy_only=False), dtype=np.int64)))[lists.offsets.to_numpy()]
    return [bool(t) and b - a == len(t) + 1 and data[a:b] == b" " + t for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


class Aligner:
    """Aligns blocks of texts; the strings of ids that groups are written with are made once."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _loaded(Bytes, path_a), _loaded(Pieces, path_b)
        words = [[f"{k}{mark}" for k in range(n)] for n, marks in ((len(self.a.raw), ",|"), (len(self.b.raw), (",", ";", ""))) for mark in marks]
        self.words = pa.array([x for part in words for x in part], pa.string())

    def __call__(self, texts: list[str | None]) -> dict[str, list | np.ndarray | pa.Array]:
        """Columns of the block's documents, and its pairs with their counts."""
        given = [t or "" for t in texts]
        raw = [t.encode() for t in given]
        a, b = self.a(given), self.b(given)
        good = [x and y for x, y in zip(_valid(raw, a, self.a.raw), _valid(raw, b, self.b.raw), strict=True)]
        none = np.zeros(0, np.uint32)
        la, lb = _lists([x if ok else none for x, ok in zip(a, good, strict=True)]), _lists([x if ok else none for x, ok in zip(b, good, strict=True)])
        ta, tb = _ended(la, self.a.raw), _ended(lb, self.b.raw)
        met = ta.join(tb, keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("place").combine_chunks()
        ends_a, ends_b, docs = (met[c].to_numpy() for c in ("place", "place_b", "doc"))
        per_doc = np.bincount(docs, minlength=len(texts))
        n_b = len(self.b.raw)
        coded = pc.add(pc.multiply(met["id"].cast(pa.int64()), n_b), met["id_b"].cast(pa.int64())).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        counts = pa.table({"k": coded.indices}).group_by("k", use_threads=False).aggregate([([], "count_all")]).sort_by("k")
        pairs = coded.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        links = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32()), coded.indices)
        return {
            "n_a": pc.list_value_length(la).cast(pa.int64()), "n_b": pc.list_value_length(lb).cast(pa.int64()), "n_groups": pa.array(per_doc, pa.int64()), "n_links": pa.array(per_doc, pa.int64()),
            "groups_sha256": self._written(ta["id"].to_numpy(), tb["id"].to_numpy(), ends_a, ends_b, per_doc), "links": links, "pairs": (pairs // n_b, pairs % n_b, counts["count_all"].to_numpy()),
        }

    def _written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, per_doc: np.ndarray) -> list[str]:
        """The hash of each document's groups as text. A group's tokens are those after the last shared end, first one side's, then the other's."""
        n_a, n_b = len(self.a.raw), len(self.b.raw)
        group_a, group_b = np.searchsorted(ends_a, np.arange(len(a))), np.searchsorted(ends_b, np.arange(len(b)))
        last = np.cumsum(per_doc)[per_doc > 0] - 1  # each document's last group
        words = np.empty(len(a) + len(b), np.int64)
        mark = np.zeros(len(b), np.int64)
        mark[ends_b] = 1
        mark[ends_b[last]] = 2
        done_b = np.concatenate(([0], ends_b + 1))
        words[np.arange(len(a)) + done_b[group_a]] = a + n_a * (ends_a[group_a] == np.arange(len(a)))
        words[np.arange(len(b)) + ends_a[group_b] + 1] = 2 * n_a + n_b * mark + b
        text = self.words.take(pa.array(words))
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        data, out, start = memoryview(text.buffers()[2] or b""), [], 0
        ends = (ends_a + ends_b + 2)[np.maximum(np.cumsum(per_doc) - 1, 0)] if len(ends_a) else np.zeros(len(per_doc), np.int64)
        for n, end in zip(per_doc, ends, strict=True):
            out.append(hashlib.sha256(data[at[start] : at[end]]).hexdigest() if n else "")
            start = end if n else start
        return out


def _blocks(path_a, path_b, schema: pa.Schema):
    """(doc_id, text) -> a row per document, with its links as places among its block's pairs; a block's pairs stand in its first row."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            aligner = aligner or Aligner(path_a(), path_b())
            made = aligner(batch.column(1).to_pylist())
            n = batch.num_rows
            first = lambda x: pa.array([x, *[None] * (n - 1)])
            columns = {"block": pa.array(np.full(n, block)), "doc_id": batch.column(0), **{c: made[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")}}
            columns |= dict(zip(("pair_a", "pair_b", "pair_n"), map(first, made["pairs"]), strict=True))
            yield pa.RecordBatch.from_arrays([(x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)).cast(f.type) for f, x in zip(schema, columns.values(), strict=True)], schema=schema)
            block += 1

    return align


def _summed(doc_id: pa.DataType):
    """A block's documents and its pairs' counts over the corpus -> documents with n_best and count_sum."""

    def sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        size = pairs.num_rows
        counts, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        places = pairs["place"].to_numpy()
        counts[places], best[places] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        links = docs["links"].combine_chunks()
        links = links if isinstance(links, pa.ListArray) else pa.concat_arrays(links.chunks)
        flat, lengths = pc.list_flatten(links).to_numpy(), pc.list_value_length(links).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        over = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[flat])))[np.concatenate(([0], ends))])
        told = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(told | {"n_best": pa.array(over(best), pa.int64()), "count_sum": pa.array(over(counts), pa.int64()), "groups_sha256": docs["groups_sha256"]})

    return sums


def align(docs: DataFrame, path_a, path_b) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    ``path_a`` and ``path_b`` are functions that give the tokenizers' files where they are called, a byte-level BPE and a SentencePiece
    model. A block is an Arrow batch, of bounded size in bytes whatever the texts' number and length, and the only unit that is held at
    once; copies of a text are rows like others, and no key deals them out. Texts that are null, empty, or that either tokenizer does not
    give back byte by byte have no tokens. Repeated and null ids keep their rows. Empty tables give no rows. Counts of a pair are summed in
    each block before they are moved.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = BLOCK.format(kind)
    schema = to_arrow_schema(spark.createDataFrame([], layout).schema)
    parts = cut(rows.mapInArrow(_blocks(path_a, path_b, schema), layout), "aligned")
    zipped = F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "x")
    pairs = parts.where("pair_a is not null").select("block", zipped).select("block", "place", F.col("x.pair_a").alias("a"), F.col("x.pair_b").alias("b"), F.col("x.pair_n").alias("own"))
    counts = pairs.groupBy("a", "b").agg(F.sum("own").alias("n"))
    ranked = counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).cast("long"))
    known = pairs.join(ranked, ["a", "b"]).select(F.col("block").alias("of"), "place", "n", "best")
    held = parts.drop("pair_a", "pair_b", "pair_n")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_summed(schema.field("doc_id").type), out)
