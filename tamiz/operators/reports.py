"""Documents written line by line in order, and compared without being held in one row (RND-01, AGG-15, SNK-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.sources import files


def lines_of(part: Column, rows: DataFrame, *order: str) -> DataFrame:
    """(order columns, at, value): the lines of each row's ``part``; ``at`` is a line's place in it. A null part has no lines."""
    return rows.select(*order, F.posexplode(F.split(part, "\n")).alias("at", "value"))


def write_document(lines: DataFrame, order: list[str], path: str) -> None:
    """The values of ``lines`` as text files whose names' order is theirs: ranges of ``order`` are sorted, each by a task of its own. Null is an empty line."""
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(F.coalesce("value", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def document(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of a written document."""
    return files.numbered_lines(spark, path).select("position", "value")


def digest(lines: DataFrame) -> tuple[int, int]:
    """Of (position, value): the number of lines, and a sum of hashes of each line with its position, which parts of a document may be added up to."""
    got = lines.agg(F.count("*").alias("n"), F.sum(F.xxhash64("position", "value").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], int(got["h"] or 0)


def same(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two documents, however they are split into files, have the same lines."""
    return digest(document(spark, a)) == digest(document(spark, b))


def differing(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(position, a, b): the lines that two documents differ in; one that ends first has nulls."""
    x, y = (document(spark, p).withColumnRenamed("value", n) for p, n in ((a, "a"), (b, "b")))
    return x.join(y, "position", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def build_log(records: DataFrame, facts: dict[str, object], problems: Column) -> DataFrame:
    """(part, key, at, value): an index's build log: what is known of the whole, a table row for each record (document_id, pages, chunks, crossing, characters), then those with ``problems`` (text or null)."""
    spark = records.sparkSession
    head = ["# Build log", "", *[f"- {name}: {value}" for name, value in facts.items()], "", "| document | pages | chunks | crossing | characters |", "| --- | ---: | ---: | ---: | ---: |"]
    top = spark.createDataFrame([(0, "", k, x) for k, x in enumerate(head)], "part int, key string, at int, value string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "pages", "chunks", "crossing", "characters")]
    table = records.select(F.lit(1).alias("part"), F.col("document_id").alias("key"), F.lit(0).alias("at"), _row(*cells).alias("value"))
    below = spark.createDataFrame([(2, "", k, x) for k, x in enumerate(["", "## Problems", ""])], top.schema)
    bad = records.where(problems.isNotNull()).select(F.lit(3).alias("part"), F.col("document_id").alias("key"), F.lit(0).alias("at"), F.concat(F.lit("- "), "document_id", F.lit(": "), problems).alias("value"))
    return top.unionByName(table).unionByName(below).unionByName(bad)


def evaluation_report(summary: DataFrame, each: DataFrame, modes: tuple[str, ...], facts: dict[str, object]) -> DataFrame:
    """(part, key, at, value): a table of each mode's means (mode, hit_at_3, mrr, ndcg_at_5), then for each query of ``each`` (query_id, mode, and the same) a heading and a line a mode."""
    spark, place = summary.sparkSession, lambda mode: F.array_position(F.array(*map(F.lit, modes)), F.col(mode)).cast("int")
    number = lambda c: F.format_string("%.3f", F.col(c))
    head = ["# Evaluation", "", *[f"- {name}: {value}" for name, value in facts.items()], "", "| mode | Hit@3 | MRR | nDCG@5 |", "| --- | ---: | ---: | ---: |"]
    top = spark.createDataFrame([(0, "", k, x) for k, x in enumerate(head)], "part int, key string, at int, value string")
    table = summary.select(F.lit(1).alias("part"), F.lit("").alias("key"), place("mode").alias("at"), _row(F.col("mode"), number("hit_at_3"), number("mrr"), number("ndcg_at_5")).alias("value"))
    key = F.lpad(F.col("query_id").cast("string"), 20, "0")
    titles = each.select("query_id").distinct().select(F.lit(2).alias("part"), key.alias("key"), F.explode(F.array(F.struct(F.lit(-2).alias("at"), F.lit("").alias("value")), F.struct(F.lit(-1).alias("at"), F.concat(F.lit("## "), F.col("query_id").cast("string")).alias("value")))).alias("x")).select("part", "key", "x.at", "x.value")
    told = each.select(F.lit(2).alias("part"), key.alias("key"), place("mode").alias("at"), F.concat(F.lit("- "), "mode", F.lit(": Hit@3 "), F.col("hit_at_3").cast("int").cast("string"), F.lit("; RR "), number("mrr"), F.lit("; nDCG@5 "), number("ndcg_at_5")).alias("value"))
    return top.unionByName(table).unionByName(titles).unionByName(told)
