"""Rows picked by a Bloom filter of fixed size before they are shuffled, so that a join with few keys does not move whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, unused

#: Bits of a filter: a fixed size; when data outgrow it, more rows pass, and results stay the same.
BITS = 26


def filter_of(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A Bloom filter of two bits a ``key`` (a mixed 64-bit number) as 64-bit words, 2^bits bits in all: the most that goes over the driver."""
    mask = (1 << bits) - 1
    each = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", 64 - bits))).alias("bit"))
    words = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(words).bit_length() - 1 + 6)
    keys, words = keys.view(np.uint64), words.view(np.uint64)
    ok = np.ones(len(keys), bool)
    for at in (keys & ((np.uint64(1) << bits) - np.uint64(1)), keys >> (np.uint64(64) - bits)):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def some_rows(shared, inside: bool):
    """Rows whose first column passes the filter, or those whose doesn't."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy()) == inside))

    return choose


def _split(rows: DataFrame, row: str, some: DataFrame):
    """A function that gives ``rows`` on either side of the filter of the numbers in column ``row`` of ``some``."""
    bound_batches(rows.sparkSession)
    name = unused(rows, "_key")
    marks = rows.sparkSession.sparkContext.broadcast(filter_of(some.select(F.xxhash64(row).alias("key"))))
    keyed = rows.select(F.xxhash64(row).alias(name), *rows.columns)
    return lambda inside: keyed.mapInArrow(some_rows(marks, inside), keyed.schema).drop(name)


def only(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted`` (row, ...) by their number."""
    return _split(rows, row, wanted)(True).join(wanted, row)


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``rows`` less those whose number is in ``gone`` (row)."""
    side = _split(rows, row, gone)
    return side(False).unionAll(side(True).join(gone, row, "left_anti").select(*rows.columns))
