"""Evaluation over several splits, exploratory tables, plot-ready tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.functions.geometry import l_shell
from lagfield.functions.transforms import residual
from lagfield.operators.cleaning import in_days
from lagfield.operators.histograms import parameter_heatmaps, shared_histogram
from lagfield.operators.percentiles import box_summary, exact_percentiles
from lagfield.operators.profiles import bucket_counts, bucket_of, yearly_counts
from lagfield.operators.statistics import accuracy_report

# Parameter ranges of the Te heat maps.
HEATMAP_RANGES = {"L": (1.0, 12.0), "GLAT": (-90.0, 90.0), "GMLT": (0.0, 24.0)}


def te_axis(df: DataFrame, te: str, low: float = 0.01, high: float = 0.999) -> DataFrame:
    """One row (low, high): percentiles of positive Te, with the fallback for a
    range that does not increase (ten times the low end, else plus 1000)."""
    good = df.where(F.col(te).isNotNull() & (F.col(te) > 0) & ~F.isnan(te))
    q = exact_percentiles(good, te, [low, high])
    ends = q.agg(
        F.greatest(F.lit(0.0), F.max(F.when(F.col("p") == low, F.col("value")))).alias("a"),
        F.max(F.when(F.col("p") == high, F.col("value"))).alias("b"),
    )
    spare = F.when(F.col("a") > 0, F.col("a") * 10).otherwise(F.lit(1000.0))
    return ends.select(F.col("a").alias("low"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(spare).alias("high"))


def observation_heatmaps(df: DataFrame, te: str = "Te1", bins: int = 100, ranges: dict = HEATMAP_RANGES) -> DataFrame:
    data = df.withColumn("L", l_shell("ILAT")) if "L" not in df.columns else df
    return parameter_heatmaps(data, te, ranges, te_axis(df, te), bins)


def evaluate_splits(df: DataFrame, observed: str, predicted: str, split: str, reference: str, bins: int = 100):
    """(accuracy per split, prediction-observation histogram over shared limits)."""
    return (
        accuracy_report(df, observed, predicted, [split]),
        shared_histogram(df, observed, predicted, split, reference, bins),
    )


def exploration(
    df: DataFrame,
    ts: str,
    altitude: str,
    columns: Sequence[str],
    width: int = 1000,
    tables: Sequence[str] = ("per_year", "per_bucket", "box_by_year", "box_by_bucket"),
) -> dict[str, DataFrame]:
    """Row counts and box-plot summaries by year and by altitude bucket; only those that are asked for are planned."""
    plans = {
        "per_year": lambda: yearly_counts(df, ts),
        "per_bucket": lambda: bucket_counts(df, altitude, width),
        "box_by_year": lambda: box_summary(df, columns, F.year(ts), "year"),
        "box_by_bucket": lambda: box_summary(df, columns, bucket_of(altitude, width), "bucket"),
    }
    return {name: plans[name]() for name in tables}


def track(
    df: DataFrame,
    ts: str,
    columns: Sequence[str],
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """Time-ordered columns of a track, optionally for an inclusive span of days.

    The day filter comes first, so it reaches the scan."""
    rows = df.where(in_days(ts, first_day, last_day)) if first_day and last_day else df
    return rows.select(ts, *columns).orderBy(ts)


def residuals(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", residual(observed, predicted))
