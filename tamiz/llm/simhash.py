"""SimHash fingerprints and near-duplicate classes.

A fingerprint has 64 bits. Two that differ in at most three bits differ in at most three of their eight bytes, so they share
at least five bytes at equal positions. The inverted index therefore lists each distinct fingerprint under every choice of five
(position, byte) entries it could share: a list holds fingerprints with five bytes in common, never more than the 2^24 values
that the other three bytes can take. Within a list the shared positional bytes are tallied, pairs below the guaranteed five are
dropped and the others verified by bit count. Lists report the edges of a spanning forest, not all pairs. Long lists are dealt into
sublists by a further byte, so that no task holds one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, cut, numbered, settled
from tamiz.llm.components import components

BITS, MAX_BITS, POSITIONS, SHARED = 64, 3, 8, 5
SEED = 42
#: Fingerprints of a list from which it is dealt into sublists.
LONG = 4096
#: The bits of each byte, lowest first: counts of bytes times this are counts of bits.
_BITS_OF = np.array([[c >> b & 1 for b in range(8)] for c in range(256)], np.int64)


def fingerprint_of(text: bytes | None, size: int = 3) -> int:
    """Fingerprint of one text's UTF-8 bytes: bit i is 1 if more than half the shingles' hashes set it; 0 for no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(-1, POSITIONS)
    ones = np.concatenate([np.bincount(lanes[:, p], minlength=256) @ _BITS_OF for p in range(POSITIONS)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint_of(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): a pass over the texts in place, without a shuffle. Null and blank texts get 0."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _postings(prints: DataFrame) -> DataFrame:
    """Each fingerprint once for each five of its eight positional bytes."""
    keys = []
    for k, keep in enumerate(combinations(range(POSITIONS), SHARED)):
        mask = sum(0xFF << (8 * p) for p in keep)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.k", "key.shared", "fp")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join a list's fingerprints as far as links of at most three bits reach.

    Breadth first: each fingerprint is compared once with those not yet reached, a block at a time.
    """
    left, edges = prints, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            differ = left ^ one
            tally = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
            near = (tally >= SHARED) & (np.bitwise_count(differ.view(np.uint64)) <= MAX_BITS)
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(one), int(x)) for x in found]
                queue += list(found)
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of two or more fingerprints -> edges."""
    for batch in batches:
        column = batch.column(0)
        flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        edges = [e for part in np.split(flat, ends[:-1]) for e in _forest(part)]
        edges = np.array(list(set(edges)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _dealt(postings: DataFrame) -> DataFrame:
    """Postings (k, shared, fp) of long lists -> (key, fp): sublists that together hold every pair of a list at most three bits apart.

    A list's fingerprints differ in three bytes only. Where one of these is equal, the pair is in that byte's sublist. Else each differs by
    just one bit: then the one, with that bit of the first byte flipped, and the other, with that bit of the second flipped, agree in both.
    """
    rest = F.array(*[F.array(*[F.lit(p) for p in range(POSITIONS) if p not in keep]) for keep in combinations(range(POSITIONS), SHARED)])
    at = F.get(rest, F.col("k").cast("int"))
    one = lambda p, value: F.call_function("shiftleft", F.lit(value).cast("bigint"), (8 * p).cast("int"))
    equal = F.transform(at, lambda p: F.struct(p.alias("tag"), F.col("fp").bitwiseAND(one(p, 255)).alias("value")))
    both = one(F.get(at, F.lit(0)), 255).bitwiseOR(one(F.get(at, F.lit(1)), 255))
    flipped = F.flatten(F.transform(F.slice(at, 1, 2), lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.struct(F.lit(POSITIONS).alias("tag"), F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), 8 * p + b)).bitwiseAND(both).alias("value")))))
    return postings.select("k", "shared", "fp", F.explode(F.concat(equal, flipped)).alias("x")).select("k", "shared", "x.tag", "x.value", "fp")


def links(prints: DataFrame, long: int = LONG) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that span every class of fingerprints at most three bits apart. Lists of more than ``long`` are dealt into sublists."""
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a posting list is many times its row
    postings = _postings(spread)
    many = cut(postings.groupBy("k", "shared").agg(F.count("*").alias("n")).where(F.col("n") > long).select("k", "shared"), "long")
    lists = postings.join(many, ["k", "shared"], "left_anti").groupBy("k", "shared").agg(F.collect_list("fp").alias("list"))
    parts = _dealt(postings.join(many, ["k", "shared"], "left_semi")).groupBy("k", "shared", "tag", "value").agg(F.collect_list("fp").alias("list"))
    every = lists.select("list").unionByName(parts.select("list")).where(F.size("list") > 1)
    return every.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most three bits.

    Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other; equal texts share a class;
    an empty table gives an empty result; further columns of ``docs`` are not read. A repeated doc_id keeps all its rows.
    """
    prints = cut(fingerprints(docs), "fingerprints")

    def members() -> DataFrame:
        classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        roots = components(links(classes.select("fp")))
        rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        rooted = cut(rooted, "rooted")
        best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return rooted.join(best, "root").select("fp", "component_id")

    return prints.join(settled("members", members), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest doc_id stays, nulls last, then the first row; all its columns unchanged.

    Rows go by a number of their own in a table written once, so a doc_id may be null or repeated.
    """
    rows, row = numbered(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best")

    def kept() -> DataFrame:
        found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
        return found.join(rows.select(F.col(row).alias("_row"), "doc_id"), "_row").groupBy("component_id").agg(best).select(F.col("best._row").alias(row))

    return rows.join(settled("kept", kept), row, "left_semi").select(*docs.columns)
