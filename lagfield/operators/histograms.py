"""Histograms, 2-D histograms and binned statistics over equal-width bins.

Bin limits come from a one-row aggregate that is cross-joined (one row, by
construction), so limits and counts are one plan and nothing is collected. Bin
edges follow ``low + i * (high - low) / n``; the last bin is closed. Counts combine
before the shuffle, so a hot bin sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_bins(df: DataFrame, axes: Sequence[tuple[str, str, str, str]], n: int) -> DataFrame:
    """Keep rows inside the range of every axis and add each axis' 0-based bin.

    An axis is (value, low, high, output) of column names, low < high. The quotient is
    corrected against the actual edges, so a value on an edge falls where a search over
    the edges puts it. Two projections: the first guess is computed once per row.
    """
    inside = " AND ".join(f"`{x}` >= `{lo}` AND `{x}` <= `{hi}`" for x, lo, hi, _ in axes)
    guesses = [
        f"CAST(least(floor((`{x}` - `{lo}`) / (`{hi}` - `{lo}`) * {n}), {n - 1}) AS int) AS `_g_{out}`"
        for x, lo, hi, out in axes
    ]
    edges = [f"(`{hi}` - `{lo}`) / {n} AS `_w_{out}`" for _, lo, hi, out in axes]
    fixed = [
        f"CASE WHEN `{x}` < `{lo}` + `_g_{out}` * `_w_{out}` THEN `_g_{out}` - 1"
        f" WHEN `_g_{out}` < {n - 1} AND `{x}` >= `{lo}` + (`_g_{out}` + 1) * `_w_{out}` THEN `_g_{out}` + 1"
        f" ELSE `_g_{out}` END AS `{out}`"
        for x, lo, hi, out in axes
    ]
    guessed = df.where(inside).selectExpr("*", *guesses, *edges)
    return guessed.selectExpr(*[f"`{c}`" for c in df.columns], *fixed)


def usable(c: str) -> Column:
    """A number that has a place on an axis: not null, NaN or infinite."""
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def limits(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of ``<tag>_low`` and ``<tag>_high``; a single-valued range is widened by
    half a unit on either side. Values without a place are left out; empty when there is no other."""
    aggs, ends = [], []
    for tag, c in columns.items():
        x = F.when(usable(c), F.col(c).cast("double"))
        aggs += [F.min(x).alias(f"{tag}_a"), F.max(x).alias(f"{tag}_b")]
        ends += [
            f"IF({tag}_a = {tag}_b, {tag}_a - 0.5D, {tag}_a) AS {tag}_low",
            f"IF({tag}_a = {tag}_b, {tag}_b + 0.5D, {tag}_b) AS {tag}_high",
        ]
    known = " AND ".join(f"{tag}_a IS NOT NULL" for tag in columns)
    return F.broadcast(df.agg(*aggs).where(known).selectExpr(*ends))


def _all_bins(lim: DataFrame, bins: int) -> DataFrame:
    """Every bin of axis x with its edges."""
    step = f"((x_high - x_low) / {bins})"
    frame = lim.selectExpr(f"explode(sequence(0, {bins - 1})) AS bin", "x_low", "x_high")
    return frame.selectExpr("bin", f"x_low + bin * {step} AS low", f"x_low + (bin + 1) * {step} AS high")


def histogram(df: DataFrame, x: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) over [min, max] of x; empty bins included."""
    data = df.where(usable(x)).select(F.col(x).cast("double").alias("x"))
    lim = limits(data, {"x": "x"})
    binned = with_bins(data.crossJoin(lim), [("x", "x_low", "x_high", "bin")], bins)
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return _all_bins(lim, bins).join(counts, "bin", "left").selectExpr("bin", "low", "high", "coalesce(n, 0L) AS n")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """(by…, x_bin, y_bin, n), non-empty cells only; each axis over its own range."""
    data = df.where(usable(x) & usable(y)).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    cells = data.crossJoin(limits(data, {"x": "x", "y": "y"}))
    binned = with_bins(cells, [("x", "x_low", "x_high", "x_bin"), ("y", "y_low", "y_high", "y_bin")], bins)
    return binned.groupBy(*by, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def binned_mean(df: DataFrame, x: str, v: str, bins: int = 50) -> DataFrame:
    """(bin, centre, mean): mean of v, where it is a number, in equal bins of x; null for an empty bin."""
    data = df.where(usable(x)).select(F.col(x).cast("double").alias("x"), F.when(usable(v), F.col(v)).alias("v"))
    lim = limits(data, {"x": "x"})
    binned = with_bins(data.crossJoin(lim), [("x", "x_low", "x_high", "bin")], bins)
    means = binned.groupBy("bin").agg(F.avg("v").alias("mean"))
    return _all_bins(lim, bins).join(means, "bin", "left").selectExpr("bin", "(low + high) / 2 AS centre", "mean")


def shared_histogram(
    df: DataFrame, observed: str, predicted: str, split: str, reference: str, bins: int = 100
) -> DataFrame:
    """(split, pred_bin, obs_bin, n) with one square range for all splits, taken from
    the reference split: the joint min and max of both columns. Negative values are
    invalid, and so are NaN and infinite ones; pairs outside the range are not counted."""
    good = usable(observed) & usable(predicted) & (F.col(observed) >= 0) & (F.col(predicted) >= 0)
    valid = df.where(good).select(split, observed, predicted)
    ref = valid.where(F.col(split) == reference).select(F.explode(F.array(observed, predicted)).alias("x"))
    cells = valid.crossJoin(limits(ref, {"x": "x"}))
    binned = with_bins(
        cells, [(predicted, "x_low", "x_high", "pred_bin"), (observed, "x_low", "x_high", "obs_bin")], bins
    )
    return binned.groupBy(split, "pred_bin", "obs_bin").agg(F.count(F.lit(1)).alias("n"))


def parameter_heatmaps(
    df: DataFrame,
    te: str,
    ranges: dict[str, tuple[float, float] | None],
    te_limits: DataFrame,
    bins: int = 100,
) -> DataFrame:
    """(param, x_bin, y_bin, n, max_n): Te against several parameters at once.

    ``te_limits`` is a one-row (low, high) frame, usually percentiles. A parameter
    whose range is missing or not increasing uses its own min and max. ``max_n`` is
    the largest cell over all parameters.

    The Te bin is found once per row; each parameter's bin follows in the same
    projection, and only (param, bins) triples are unfolded.
    """
    keep = f"`{te}` IS NOT NULL AND `{te}` > 0 AND NOT isnan(`{te}`)"
    good = df.where(keep).selectExpr(f"`{te}` AS y", *[f"CAST(`{p}` AS double) AS `{p}`" for p in ranges])
    own = {p: p for p, r in ranges.items() if r is None or not r[1] > r[0]}
    points = good.crossJoin(F.broadcast(te_limits.selectExpr("low AS y_low", "high AS y_high")))
    if own:
        points = points.crossJoin(limits(good, own))
    fixed = [
        f"{float(r[i])!r}D AS `{p}_{end}`" for p, r in ranges.items() if p not in own for i, end in enumerate(("low", "high"))
    ]
    points = with_bins(points.selectExpr("*", *fixed), [("y", "y_low", "y_high", "y_bin")], bins)
    melted = ", ".join(f"struct('{p}' AS param, `{p}` AS x, `{p}_low` AS x_low, `{p}_high` AS x_high)" for p in ranges)
    cells = with_bins(
        points.selectExpr("y_bin", f"inline(array({melted}))"), [("x", "x_low", "x_high", "x_bin")], bins
    )
    counts = cells.groupBy("param", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    # The window sees at most params x bins x bins counted cells.
    return counts.withColumn("max_n", F.max("n").over(W.partitionBy()))
