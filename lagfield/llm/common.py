"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.session import configure, scratch

# Rows and bytes handed to Python at a time; texts can be long.
ARROW_ROWS = 2000
ARROW_BYTES = "8m"
# White space of every contract here: the space and the bytes 9 to 13.
BLANK = r"[\x20\x09-\x0D]+"
# Rows whose remainder is 0 are held out from learning.
FOLDS = 5


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read from there.

    Cuts the lineage: a lost executor makes no earlier step run again. The folder is
    the one of spark.checkpoint.dir; ``discard`` removes the table.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``settle`` wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "settled_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` already has it in any case."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def located(df: DataFrame, file: str, row: str) -> DataFrame:
    """``df`` with the file and the row number each of its rows is stored at.

    Rows read straight from Parquet have a place already. Any other frame is written to
    the shared folder first, which gives its rows one that no rerun changes.
    """
    try:
        return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return located(settle(df, "landed"), file, row)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id, written as text, divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def text_groups(docs: DataFrame, text_col: str, chars: int) -> int:
    """How many groups of about ``chars`` bytes of text the documents make; at least one."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // chars))
