"""The registered queries: thin calls of this package's operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import alignment, decontaminate, langid, licenses, merkle, neighbours, packing, quality, secrets, sharding, simhash, suffixes, warc
from tamiz.llm.common import new_folder, settled, table
from tamiz.llm.oracles import ORACLES


def tokenizer_path() -> str:
    """The public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    def records() -> DataFrame:
        path = new_folder(spark, "archives")
        warc.write(table(spark, sf_dir, "pages"), path)
        return warc.read(spark, path)

    found = warc.resolve(settled("records", records))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("lang", "source")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return neighbours.search(neighbours.index(vectors), asked)


def piece_path() -> str:
    """The public SentencePiece model of 32,000 pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path, piece_path)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.manifest(table(spark, sf_dir, "documents"), columns, claimed=merkle.spoilt(columns))


QUERIES = {
    f.__name__: f for f in (op1_licenses, op2_archives, op3_decontaminate, op4_packing, op5_language, op6_repeats, op7_secrets, op8_shards, op9_quality, op10_simhash, op11_neighbours, op12_alignment, op13_merkle)
}
__all__ = ["ORACLES", "QUERIES"]
