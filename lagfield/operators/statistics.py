"""Column statistics and the accuracy report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.functions.transforms import cross_entropy
from lagfield.schema import ABSOLUTE_THRESHOLDS, RELATIVE_THRESHOLDS


def moments(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(name, n, mean, m2) over all cells of each group: count, mean, sum of squared deviations.

    A group lists scalar columns, array columns, or both. Cells are unfolded inside
    the scan and aggregated at once (moments merge, so partial results combine before
    the shuffle of one row per group and task). Nulls and NaN are skipped.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def part(c: str) -> str:
        return f"CAST(`{c}` AS array<double>)" if isinstance(kinds[c], T.ArrayType) else f"array(CAST(`{c}` AS double))"

    packs = ", ".join(
        f"struct('{g}' AS name, concat({', '.join(part(c) for c in cols)}) AS cells)" for g, cols in groups.items()
    )
    cells = df.selectExpr(f"inline(array({packs}))").selectExpr("name", "explode(cells) AS v")
    found = cells.where("v IS NOT NULL AND NOT isnan(v)").groupBy("name")
    return found.agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")
    )


def merged_moments(parts: DataFrame) -> DataFrame:
    """The moments (name, n, mean, m2) of all chunks together, from those of each chunk.

    Exact in any order and grouping of chunks: the deviations of the chunks' means from
    the common mean join their own squared deviations. ``parts`` has one row a chunk and name, so both
    steps are small; no cell is read again.
    """
    some = parts.where("n > 0")
    whole = some.groupBy("name").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    return (
        some.join(whole, "name")
        .groupBy("name")
        .agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(apart).alias("m2"))
    )


def stats_of(merged: DataFrame, sample: bool = False) -> DataFrame:
    """(name, mean, std) of moments: population std, or sample std (null for a single value)."""
    n = F.col("n") - 1 if sample else F.col("n")
    return merged.select("name", "mean", F.sqrt(F.try_divide("m2", n)).alias("std"))


def pooled_stats(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(name, mean, std): mean and population std over all cells of each group."""
    return stats_of(moments(df, groups))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, mean, std): mean and sample std of each column, in one pass."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = F.when(~F.isnan(c), F.col(c))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"d{i}")]
        rows.append(F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("mean"), F.col(f"d{i}").alias("std")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# -- accuracy ---------------------------------------------------------------


def r_squared(observed: Column, predicted: Column) -> Column:
    spread = F.var_pop(observed) * F.count(observed)
    return F.lit(1.0) - F.try_divide(F.sum(F.pow(observed - predicted, 2)), spread)


def rmse(observed: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(predicted - observed, 2)))


def mean_deviation(observed: Column, predicted: Column) -> Column:
    return F.avg(predicted - observed)


def within_absolute(observed: Column, predicted: Column, limit: float) -> Column:
    """Percent of rows whose deviation is at most ``limit``."""
    return F.avg((F.abs(predicted - observed) <= F.lit(float(limit))).cast("int")) * 100.0


def within_relative(observed: Column, predicted: Column, percent: float) -> Column:
    """Percent of rows deviating at most ``percent`` of the truth; a zero truth counts
    as outside."""
    ratio = F.try_divide(F.abs(predicted - observed), observed) * 100.0
    inside = F.when(observed.isNotNull() & predicted.isNotNull(), F.coalesce(ratio <= F.lit(float(percent)), F.lit(False)))
    return F.avg(inside.cast("int")) * 100.0


def accuracy_report(
    df: DataFrame,
    observed: str,
    predicted: str,
    by: Sequence[str] = (),
    entropy: str | None = None,
) -> DataFrame:
    """R², RMSE, mean deviation, shares within thresholds (and mean entropy), one row
    per ``by`` group. Rows without a usable prediction are left out. Every measure is
    an algebraic aggregate, so a hot group combines before the shuffle."""
    ok = F.col(observed).isNotNull() & F.col(predicted).isNotNull() & ~F.isnan(predicted)
    extra = {"_h": F.col(entropy)} if entropy else {}
    # Masked rather than filtered: a filter on the prediction would be pushed below it
    # and compute the whole model a second time.
    rows = df.withColumns({"_ok": ok, **extra}).select(
        *by,
        F.when(F.col("_ok"), F.col(observed)).alias("_t"),
        F.when(F.col("_ok"), F.col(predicted)).alias("_p"),
        *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in extra],
    )
    t, p = F.col("_t"), F.col("_p")
    aggs = [
        F.count(t).alias("n"),
        r_squared(t, p).alias("r2"),
        rmse(t, p).alias("rmse"),
        mean_deviation(t, p).alias("mean_deviation"),
        *[within_absolute(t, p, k).alias(f"within_{k}") for k in ABSOLUTE_THRESHOLDS],
        *[within_relative(t, p, k).alias(f"within_{k}_percent") for k in RELATIVE_THRESHOLDS],
    ]
    if entropy:
        aggs.append(F.avg("_h").alias("mean_entropy"))
    return rows.groupBy(*by).agg(*aggs).where(F.col("n") > 0)


def long_report(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Report columns as (by…, metric, value) rows."""
    metrics = [c for c in report.columns if c not in by]
    cast = report.select(*by, *[F.col(c).cast("double").alias(c) for c in metrics])
    return cast.unpivot(list(by), metrics, "metric", "value")


def mean_loss(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Mean cross-entropy over rows (row-weighted, so batch size plays no part)."""
    return df.agg(F.avg(cross_entropy(scores, label)).alias("loss"))


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
