"""Folders that are replaced as a whole, and batches that may be written again.

A folder is written beside its place, listed in a manifest, and put in place by a rename. A
job that dies before that leaves the old folder as it was; one that dies between the two renames
of a replacement leaves it under a name that the next call, or ``restore``, puts back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"
#: Marks of folders that wait beside their place: being written, and being replaced.
STAGED, REPLACED = ".staged-", ".replaced"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, old: str, new: str) -> None:
    at, fs = _files(spark, old)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"could not rename {old} to {new}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file below ``path``, bytes) of every data file; nothing is read but the listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return found.select(name.alias("file"), F.col("length").alias("bytes")).where(~F.col("file").rlike("(^|/)[_.]"))


def restore(spark: SparkSession, path: str) -> None:
    """Put back a folder whose replacement was begun and not ended."""
    path = path.rstrip("/")
    (at, fs), (old, _) = _files(spark, path), _files(spark, path + REPLACED)
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            _rename(spark, path + REPLACED, path)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Replace the folder ``path`` by what ``write`` puts into the folder it is given."""
    path = path.rstrip("/")
    staged = f"{path}{STAGED}{uuid.uuid4().hex[:12]}"
    restore(spark, path)
    try:
        write(staged)
        listing(spark, staged).coalesce(1).write.json(f"{staged}/{MANIFEST}")  # one line a file
    except BaseException:
        at, fs = _files(spark, staged)
        fs.delete(at, True)
        raise
    (at, fs), (old, _) = _files(spark, path), _files(spark, path + REPLACED)
    if fs.exists(at):
        _rename(spark, path, path + REPLACED)
    _rename(spark, staged, path)
    fs.delete(old, True)
    return path


def missing_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of files that the manifest of ``path`` names and that are not there with that size."""
    named = spark.read.schema("file string, bytes long").json(f"{path.rstrip('/')}/{MANIFEST}")
    return named.join(listing(spark, path), ["file", "bytes"], "left_anti")


def append_batch(df: DataFrame, path: str, schema: T.StructType, batch: str, column: str = "batch") -> str:
    """Append the rows of one batch with a fixed schema; the same batch again takes the place of its first rows.

    Columns are matched by name and cast, or it fails. ``column`` holds the batch and is a folder
    of the table, so no other batch is touched.
    """
    (
        df.to(schema)
        .withColumn(column, F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )
    return path
