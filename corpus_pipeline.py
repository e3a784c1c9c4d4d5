"""From documents to packed sequences: language, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import decontaminate, langid, packing, secrets, shingles
from tamiz.llm.common import settled, table
from tamiz.llm.queries import tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as of the text that a stage has left."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, with 0.8 or more of their five-word shingles in common, stays.

    SimHash's positional index gives the first pairs, lists of shared shingles those that differ in more bits; all are verified.
    """
    return shingles.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(secrets.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence, with its ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("secret_scan", secret_spans),
    ("packing", sequences),
]

#: The network of the first stage can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage gives is written and read again; tables that no later step reads are deleted."""

    def given(k: int) -> DataFrame:
        """The documents that stage ``k`` starts from."""
        if not k:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k - 1]
        return settled(name, lambda: stage(spark, given(k - 1), sf_dir))

    return STAGES[-1][1](spark, given(len(STAGES) - 1), sf_dir)
