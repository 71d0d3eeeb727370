"""Altitude profiles, conditional means by nearest centre, dense bucket counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfield.functions.thermal import day_part
from lagfield.functions.transforms import nearest_centre
from lagfield.operators.cleaning import sectors

# Centres of invariant latitude, and the profile's bin width in km.
ILAT_CENTRES = (20, 30, 40, 50)
PROFILE_STEP = 20
PROFILE_MIN_ROWS = 10


def altitude_profile(
    df: DataFrame,
    te: str = "Te1",
    ilat: str = "ILAT",
    altitude: str = "Altitude",
    gmlt: str = "GMLT",
    ilat_range: tuple[float, float] = (40.0, 50.0),
    step: int = PROFILE_STEP,
    min_rows: int = PROFILE_MIN_ROWS,
) -> DataFrame:
    """Te against altitude for the day, night and all sectors, in one scan.

    Left-closed bins of ``step`` km; bins with fewer than ``min_rows`` rows are left
    out. Bin edges run up to the first multiple of the step at or above the highest
    altitude of the sector, so a row exactly on that edge is in no bin.
    """
    base = df.where(F.col(ilat).between(*ilat_range)).where((F.col(te) > 0) & (F.col(altitude) > 0))
    base = base.where(~F.isnan(te) & ~F.isnan(altitude) & F.col(gmlt).isNotNull())
    bin_low = (F.floor(F.col(altitude) / step) * step).cast("double")
    # Rows combine per (sector set, bin) first; only those few groups are exploded.
    parts = base.groupBy(sectors(gmlt).alias("tags"), bin_low.alias("bin_low")).agg(
        F.sum(te).alias("st"),
        F.min(te).alias("lt"),
        F.max(te).alias("ht"),
        F.sum(altitude).alias("sa"),
        F.max(altitude).alias("ha"),
        F.count(F.lit(1)).alias("c"),
    )
    bins = parts.withColumn("sector", F.explode("tags")).groupBy("sector", "bin_low").agg(
        (F.sum("st") / F.sum("c")).alias("mean_te"),
        F.min("lt").alias("min_te"),
        F.max("ht").alias("max_te"),
        (F.sum("sa") / F.sum("c")).alias("mean_alt"),
        F.max("ha").alias("ha"),
        F.sum("c").alias("n"),
    )
    top = F.max("ha").over(W.partitionBy("sector"))
    return (
        bins.withColumn("top", top)
        .where((F.col("bin_low") < F.col("top")) & (F.col("n") >= min_rows))
        .select(
            "sector",
            "bin_low",
            "mean_te",
            "min_te",
            "max_te",
            "mean_alt",
            "n",
            (F.col("mean_te") - F.col("min_te")).alias("error_low"),
            (F.col("max_te") - F.col("mean_te")).alias("error_high"),
        )
    )


def nearest_centre_means(
    df: DataFrame,
    ts: str,
    ilat: str,
    values: Sequence[str],
    centres: Sequence[float] = ILAT_CENTRES,
) -> DataFrame:
    """(centre, part, mean_<value>…) for Day and Night; null where a cell is empty."""
    cells = (
        df.select(nearest_centre(ilat, centres).alias("centre"), day_part(ts).alias("part"), *values)
        .where(F.col("centre").isNotNull() & F.col("part").isin("Day", "Night"))
        .groupBy("centre", "part")
        .agg(*[F.avg(v).alias(f"mean_{v}") for v in values])
    )
    full = F.array(
        *[F.struct(F.lit(float(c)).alias("centre"), F.lit(p).alias("part")) for c in centres for p in ("Day", "Night")]
    )
    frame = df.sparkSession.range(1).select(F.inline(full))
    return frame.join(cells, ["centre", "part"], "left")


def wide_centre_means(means: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per centre with ``mean_<value>_Day`` and ``mean_<value>_Night``."""
    aggs = [
        F.max(F.when(F.col("part") == p, F.col(f"mean_{v}"))).alias(f"mean_{v}_{p}")
        for v in values
        for p in ("Day", "Night")
    ]
    return means.groupBy("centre").agg(*aggs)


def yearly_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n")).where("year IS NOT NULL")


def bucket_of(x: str, width: int) -> Column:
    """Lower limit of the right-closed bucket (low, low+width] holding a positive x."""
    x = F.col(x)
    return F.when(x > 0, (F.ceil(x / width) - 1) * width).cast("bigint")


def bucket_label(low: Column, width: int) -> Column:
    return F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string"))


def bucket_counts(df: DataFrame, x: str, width: int = 1000) -> DataFrame:
    """(bucket, label, n) from zero to the maximum, empty buckets included.

    Rows beyond the last whole bucket edge (the edges run in steps of ``width`` while
    below the truncated maximum plus ``width``) are not counted.
    """
    top = df.agg(F.max(x).cast("bigint").alias("top"))
    low = bucket_of(x, width)
    counts = df.groupBy(low.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("bucket IS NOT NULL")
    frame = top.where("top > 0").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") - 1, F.lit(width).cast("bigint"))).alias("bucket")
    )
    return frame.join(counts, "bucket", "left").select(
        "bucket", bucket_label(F.col("bucket"), width).alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
