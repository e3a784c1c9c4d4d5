"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may lack the setting; it then gets a fresh temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders made inside calls of ``settled``, one list per call.
_MADE: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tamiz/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``build`` returns; folders that ``build`` has made are deleted then, since only its result is read on."""
    _MADE.append([])
    try:
        df = build()
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/tamiz/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        spent = _MADE.pop()
    if _MADE:
        _MADE[-1].append(path)
    for folder in spent:
        discard(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written once, with a number for each row, and that column's name."""
    name = unused(docs, "_row")
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def text_of(df: DataFrame, column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value, body):
    """``body`` of a value that is worked out once, also where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound_batches(spark: SparkSession, most: str = "1m") -> None:
    """Arrow batches hold at most ``most`` bytes (or one longer row), so that workers' memory does not grow with the texts' length.

    The session's own setting, if there is one, stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``cut`` or ``new_folder`` made and that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def gathered(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table as one partition if it has at most ``most`` rows, so that small rounds of an iteration need no exchange; else as it is."""
    return df.coalesce(1) if df.count() <= most else df
