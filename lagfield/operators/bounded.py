"""Results that several later steps read, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lagfield.session import scratch


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts its lineage (lost executors recompute nothing) and gives later joins its true
    size in bytes, by which Spark chooses between broadcast and shuffle.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
