"""Sinks: named splits, chunked splits, frozen-schema batches, statistics files.

Folders are replaced as a whole (see ``publish``): a job that fails leaves the old one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.operators.statistics import merged_moments, moments, stats_of
from lagfield.sources.publish import append_batch, publish

CHUNK_ROWS = 250_000
MOMENTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
    ]
)
STATS_SCHEMA = "mean map<string,double>, std map<string,double>"


def write_split(df: DataFrame, base: str, name: str) -> str:
    """Replace ``base/name`` by this table."""
    return publish(df.sparkSession, f"{base.rstrip('/')}/{name}", df.write.parquet)


def write_in_files(df: DataFrame, path: str, rows: int = CHUNK_ROWS) -> str:
    """Replace a directory by files of at most ``rows`` rows; no shuffle."""
    return publish(df.sparkSession, path, df.write.option("maxRecordsPerFile", rows).parquet)


def write_chunks(numbered: DataFrame, path: str, rank: str = "rank", rows: int = CHUNK_ROWS) -> str:
    """Replace a directory by numbered chunks of exactly ``rows`` rows (last one less).

    ``rank`` numbers the rows from 1 (see ``sampling.ranked``). Rows are shuffled on
    the chunk id, so each chunk is written by one task and chunks run in parallel.
    """
    chunk = F.floor((F.col(rank) - 1) / rows).cast("bigint") + 1
    chunks = numbered.withColumn("chunk", chunk).drop(rank).repartition("chunk")
    return publish(numbered.sparkSession, path, chunks.write.partitionBy("chunk").parquet)


def append_frozen(df: DataFrame, path: str, schema: T.StructType, batch: str) -> str:
    """Append a batch with a fixed schema; written again, it takes its own place."""
    return append_batch(df, path, schema, batch)


def write_stats(stats: DataFrame, path: str) -> str:
    """Save (name, mean, std) rows as one JSON record of two maps."""
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("name", v)))
    one = stats.agg(entry("mean").alias("mean"), entry("std").alias("std"))
    one.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(name, mean, std) rows of a statistics file; both maps must be there."""
    raw = spark.read.schema(STATS_SCHEMA).option("multiLine", True).json(path)
    if raw.where("mean IS NULL OR std IS NULL").limit(1).count() or raw.isEmpty():
        raise ValueError(f"{path} lacks a mean or std map")
    return raw.select(F.explode("mean").alias("name", "mean"), F.col("std")).select(
        "name", "mean", F.try_element_at("std", F.col("name")).alias("std")
    )


def write_moments(df: DataFrame, groups: dict[str, Sequence[str]], path: str, chunk: str) -> str:
    """Moments of one chunk of rows beside those of earlier chunks; a chunk written again takes its own place."""
    return append_batch(moments(df, groups), path, MOMENTS, chunk, "chunk")


def read_moments(spark: SparkSession, path: str, sample: bool = False) -> DataFrame:
    """(name, mean, std) over all chunks whose moments lie at ``path``; no row is read again."""
    parts = spark.read.schema(T.StructType([*MOMENTS, T.StructField("chunk", T.StringType())])).parquet(path)
    return stats_of(merged_moments(parts), sample)


def stats_as_maps(stats: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Two Python dicts for use as literals; there is one row a column or group of the table."""
    rows = stats.select("name", "mean", "std").collect()
    return {r.name: r.mean for r in rows}, {r.name: r.std for r in rows}


def load_or_compute_stats(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    try:
        return read_stats(spark, path)
    except AnalysisException:
        write_stats(compute(), path)
        return read_stats(spark, path)
