"""Sources and sinks (SRC-*, SNK-*): strict CSV, JSON lines, Markdown lines, file lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import text
from tamiz.session import written


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01: all columns as trimmed strings, empty and missing as ""; a missing required column is an error; a byte-order mark is ignored."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[text.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in df.columns])


def integers(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as integers; what is none is an error, not a null."""
    cast = lambda c: F.coalesce(F.col(c).try_cast("int"), F.raise_error(F.concat(F.lit(f"{c} is no integer: "), F.col(c))))
    return df.withColumns({c: cast(c) for c in columns})


#: Types in the order of their flags; a column is what the flags of all its values together admit.
KINDS = ("boolean", "bigint", "double", "string")


def _flag(c: str) -> Column:
    """What a value can be: 0 if it is blank, else one bit."""
    v = F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    number = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    return F.when(v == "", 0).when(v.rlike("(?i)^(true|false)$"), 1).when(v.rlike("^[+-]?[0-9]{1,18}$"), 2).when(v.rlike(number), 4).otherwise(8)


def inferred(df: DataFrame) -> DataFrame:
    """SRC-06: (name, kind) of text columns, from every row: boolean, bigint, double, string, or missing where all is blank.

    Flags are merged by bit-wise or in each task, so one pass over the table gives one row, whatever its size. Whole numbers among
    fractions are fractions; any other mixture is text.
    """
    flags = df.agg(*[F.bit_or(_flag(c)).alias(str(k)) for k, c in enumerate(df.columns)])
    kinds = F.create_map(*[F.lit(x) for pair in {0: "missing", 1: "boolean", 2: "bigint", 4: "double", 6: "double"}.items() for x in pair])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(str(k)), F.lit(0)).alias("flags")) for k, c in enumerate(df.columns)])).alias("x")
    return flags.select(each).select("x.name", F.coalesce(F.try_element_at(kinds, F.col("x.flags")), F.lit("string")).alias("kind"))


def typed(df: DataFrame) -> DataFrame:
    """SRC-06: ``df`` with its columns cast to what ``inferred`` says; blanks are null, columns without values stay text."""
    kinds = {r.name: r.kind for r in inferred(df).collect()}  # a row for each column
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    return df.select(*[(F.col(f"`{c}`") if kinds[c] in ("string", "missing") else value(c).cast(kinds[c])).alias(c) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-07."""
    return spark.read.schema(schema).json(path)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """SRC-08: of records with one key, the last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, "_x.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08, SET-05: (path, line, position, value) of text files that Spark may read in any number of splits; ``line`` counts from 0 in a file, ``position`` over all files by name.

    Two passes over a table that is written once: rows are counted per split, and what stands in the splits before is added. Only these
    counts are put in order. An absent path is an empty table.
    """
    try:
        found = spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, line long, position long, value string")
    rows = written(found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value"), "lines")
    splits = rows.groupBy("path", "_split").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    files = splits.groupBy("path").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = files.select("path", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_files"))
    own = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_split", (F.coalesce(F.sum("n").over(own), F.lit(0)) - F.col("_first")).alias("_shift")).join(before, "path")
    placed = rows.join(starts, ["path", "_split"]).withColumn("line", F.col("_at") + F.col("_shift"))
    return placed.select("path", "line", (F.col("line") + F.col("_files")).alias("position"), "value")


def last_line_per_key(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """SRC-08: JSON lines, of which the last with a key counts; lines that are blank have no record, lines that are no JSON object are an error."""
    text_lines = numbered_lines(spark, path).where(F.trim("value") != "")
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return last_per_key(text_lines.select("position", record.alias("x")).select("position", "x.*"), key, "position").drop("position")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, each file read whole: for documents, not for data."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def sections(of: DataFrame, heading: str = r"^## (T\d+)") -> DataFrame:
    """SRC-14: ``- key: value`` fields under each heading."""
    found = F.nullif(F.regexp_extract("value", heading, 1), F.lit(""))
    filled = of.withColumn("section", F.last(found, ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    field = lambda k: F.regexp_extract("value", r"^- ([^:]+): (.*)$", k)
    return filled.where(F.col("section").isNotNull() & (field(1) != "")).select("path", "section", field(1).alias("key"), text.strip(field(2)).alias("text"))


def id_lines(of: DataFrame, prefix: str = r"[A-Z]\w*(?:-\d+)?") -> DataFrame:
    """SRC-15: ``ID | text`` lines."""
    part = lambda k: F.regexp_extract("value", rf"^({prefix}) \| (.*)$", k)
    return of.where(part(1) != "").select("path", "line", part(1).alias("id"), text.strip(part(2)).alias("text"))


def cells(of: DataFrame, n: int = 5) -> DataFrame:
    """SRC-16: rows of a pipe table with exactly ``n`` cells, rules left out."""
    made = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return of.where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^[\s|:-]+$")).select("path", "line", made.alias("cells")).where(F.size("cells") == n)


def lock(of: DataFrame) -> DataFrame:
    """SRC-17: ``name digest`` lines."""
    made = text.words(F.col("value"))
    return of.where(F.size(made) == 2).select(F.get(made, F.lit(0)).alias("name"), F.get(made, F.lit(1)).alias("digest"))


def diff(of: DataFrame) -> DataFrame:
    """SRC-18: removed and added lines of a unified diff."""
    kind: Column = F.when(F.col("value").rlike(r"^(---|\+\+\+)"), None).when(F.col("value").startswith("-"), "removed").when(F.col("value").startswith("+"), "added")
    return of.withColumn("kind", kind).where("kind is not null").select("path", "line", "kind", F.expr("substring(value, 2)").alias("text"))


def turns(of: DataFrame) -> DataFrame:
    """SRC-19: ``Host:`` and ``Guest:`` turns in order."""
    part = lambda k: F.regexp_extract("value", r"^(Host|Guest):\s*(.*)$", k)
    return of.where(part(1) != "").select("path", F.row_number().over(Window.partitionBy("path").orderBy("line")).alias("turn"), part(1).alias("speaker"), part(2).alias("text"))


def files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """SRC-13, HSH-01: (path, digest) of files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.sha2("content", 256).alias("digest"))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """SNK-01: fixed fields in order, null and missing as ""."""
    made = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.select(*made).write.csv(path, header=True, quote='"', escape='"', emptyValue="")


def rewrite_csv(df: DataFrame, path: str, declared: list[str], optional: tuple[str, ...] = ()) -> None:
    """SNK-02, SNK-03: the declared columns in their order, then those optional ones that are there; other columns are left out."""
    write_csv(df, path, [*declared, *[c for c in optional if c in df.columns and c not in declared]])


def append_trace(row: DataFrame, path: str, fields: list[str]) -> None:
    """SNK-04: rows added to a trace; what is there stays."""
    row.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).write.mode("append").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-05: a record per line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """SRC-09: a JSON document over several lines; a required field that is missing or null is an error."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required]) if required else F.lit("")
    checked = df.withColumn("_lacks", lacks)
    if bad := checked.where("_lacks <> ''").limit(1).collect():
        raise ValueError(f"missing fields: {bad[0]['_lacks']}")
    return df


def write_lock(of: DataFrame, path: str) -> None:
    """SNK-14: ``name digest`` lines."""
    of.select(F.concat_ws(" ", "name", "digest").alias("value")).write.mode("overwrite").text(path)


def without_text(report: DataFrame, texts: tuple[str, ...] = ("text", "quote", "verbatim_excerpt")) -> DataFrame:
    """SNK-12: a report without the columns that carry passages."""
    return report.drop(*texts)
