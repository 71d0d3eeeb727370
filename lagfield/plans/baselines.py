"""Empirical temperature models applied to tables, and the curves drawn from them."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.functions import geometry as G
from lagfield.functions import thermal as H
from lagfield.functions.timeops import numeric_grid
from lagfield.operators.profiles import nearest_centre_means, wide_centre_means
from lagfield.schema import TIME

# Heights of the fitted profile (km) and the searched gradients.
PROFILE_HEIGHTS = tuple(range(400, 2001, 100))
GRADIENT_FIRST, GRADIENT_LAST, GRADIENT_COUNT = -20.0, 50.0, 701
POWER = 2.0 / 7.0
# Candidates from one that is always tried to the next, and rows searched together (their errors stay in cache).
GRADIENT_STEP, SEARCH_ROWS = 25, 256
TASKS_A_CORE = 3
ENDS = (slice(None, -1), slice(1, None))


def polynomial_model(df: DataFrame, ts: str = TIME) -> DataFrame:
    """Day and night rows with s_L, T_0, G_0 and the model temperature ``Te_model``."""
    rows = df.withColumn("day_part", H.day_part(ts)).where(F.col("day_part").isin("Day", "Night"))
    rows = rows.withColumn("s_L", G.foot_sine_squared("GLAT", "Altitude"))
    rows = rows.withColumns({"T_0": H.base_value("day_part", "s_L", "T0"), "G_0": H.base_value("day_part", "s_L", "G0")})
    return rows.withColumn("Te_model", H.temperature_at("Altitude", "T_0", "G_0", "ILAT"))


def fit_gradient(profile: str, ilat: str) -> Column:
    """G0 of the grid whose curve through the profile's first value has the least
    squared error over the profile heights; the first such on ties, to one decimal.

    The geometry factor of each height is a Spark expression. Only the search itself
    runs on Arrow batches in NumPy: as nested lambdas it took about 8 ms a row, and
    exploding candidates would multiply the rows by 701. It is heavy for a row's size:
    deal rows out first, as ``fitted_model`` does.
    """
    terms = F.array(*[H.line_term(F.lit(float(h)), G.l_shell(ilat)) for h in PROFILE_HEIGHTS])
    return F.round(_search()(F.col(profile).cast("array<double>"), terms), 1)


def best_candidates(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place in the grid of the first candidate with the least finite error for each profile, or -1.

    Every ``GRADIENT_STEP``-th candidate is tried. Between two of them each residual and each
    slope of the curve is monotone, so their products at the two ends bound the slope of the error.
    Where that keeps its sign by more than rounding, or the bracket is negative throughout, none in
    between is the best; all candidates of the other intervals are tried.
    """
    grid = np.linspace(GRADIENT_FIRST, GRADIENT_LAST, GRADIENT_COUNT)
    nodes = np.unique(np.append(np.arange(0, GRADIENT_COUNT, GRADIENT_STEP), GRADIENT_COUNT - 1))
    with np.errstate(all="ignore"):
        x = grid[nodes] / y[:, :1]
        tried, scale = np.zeros_like(x), np.zeros_like(x)
        low, high = np.zeros_like(x[:, 1:]), np.zeros_like(x[:, 1:])
        undefined = np.zeros(low.shape, bool)
        for k in range(y.shape[1]):
            bracket = 1.0 + x * c[:, k, None]
            curve = y[:, :1] * bracket**POWER
            off = y[:, k, None] - curve
            tried += off**2
            scale += (np.abs(y[:, k, None]) + np.abs(curve)) ** 2
            slope = c[:, k, None] * curve / bracket  # times POWER / y[0]
            ends = [off[:, i] * slope[:, j] for i in ENDS for j in ENDS]
            low += functools.reduce(np.minimum, ends)
            high += functools.reduce(np.maximum, ends)
            undefined |= (bracket[:, :-1] < 0) & (bracket[:, 1:] < 0)
        rounding = 1e-12 * np.maximum(scale[:, :-1], scale[:, 1:]) * np.abs(y[:, :1])
        # Comparisons with NaN are false: such intervals are tried.
        row, interval = np.nonzero(~((low > rounding) | (high < -rounding) | undefined))
        error = np.full((len(y), GRADIENT_COUNT), np.inf)
        error[:, nodes] = tried
        for begin in range(0, len(row), SEARCH_ROWS):
            own = row[begin : begin + SEARCH_ROWS]
            at = np.minimum(nodes[interval[begin : begin + SEARCH_ROWS], None] + np.arange(1, GRADIENT_STEP), GRADIENT_COUNT - 1)
            x, inner = grid[at] / y[own, :1], np.zeros(at.shape)
            for k in range(y.shape[1]):
                inner += (y[own, k, None] - y[own, :1] * (1.0 + x * c[own, k, None]) ** POWER) ** 2
            error[own[:, None], at] = inner
    error[~np.isfinite(error)] = np.inf
    return np.where(np.isfinite(error).any(axis=1), error.argmin(axis=1), -1)


def _search():
    @F.arrow_udf("double")
    def search(profile: pa.Array, terms: pa.Array) -> pa.Array:
        grid = np.linspace(GRADIENT_FIRST, GRADIENT_LAST, GRADIENT_COUNT)
        out = np.full(len(profile), np.nan)
        lengths = pc.fill_null(pc.list_value_length(profile), 0).to_numpy(zero_copy_only=False)
        lengths = np.where(terms.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        for length in set(lengths.tolist()) - {0}:
            rows = np.flatnonzero(lengths == length)
            y, c = (
                pc.list_flatten(a.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                for a in (profile, terms)
            )
            usable = np.flatnonzero(np.isfinite(y).all(axis=1) & np.isfinite(c[:, :length]).all(axis=1))
            for begin in range(0, len(usable), SEARCH_ROWS):
                own = usable[begin : begin + SEARCH_ROWS]
                best = best_candidates(y[own], c[own])
                out[rows[own[best >= 0]]] = grid[best[best >= 0]]
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return search


def fitted_model(df: DataFrame, profile: str = "profile") -> DataFrame:
    """Per-row fit: reference temperature, best gradient and temperature at the row's altitude.

    Rows are few bytes and much work, so a file that one task reads is dealt out to all
    cores, some tasks each.
    """
    dealt = df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    fitted = dealt.withColumns({"T_ref": F.get(profile, F.lit(0)), "best_G0": fit_gradient(profile, "ILAT")})
    return fitted.withColumn("Te_model", H.temperature_at("Altitude", "T_ref", "best_G0", "ILAT")).drop(profile)


def centre_curves(
    df: DataFrame, ts: str = TIME, last_height: int = 5100, step: int = 25
) -> DataFrame:
    """Day and night Te(h) of both models from mean parameters per latitude centre.

    Needs columns ``T_ref`` and ``best_G0`` (fitted model). A centre lacking any of
    the means is left out.
    """
    v = df.where(F.col("ILAT").between(15, 55)).withColumn("day_part", H.day_part(ts))
    v = v.withColumn("s", G.latitude_sine_squared("GLAT"))
    v = v.withColumns({"v1_T0": H.base_value("day_part", "s", "T0"), "v1_G0": H.base_value("day_part", "s", "G0")})
    names = ["v1_T0", "v1_G0", "T_ref", "best_G0"]
    wide = wide_centre_means(nearest_centre_means(v, ts, "ILAT", names), names).na.drop()
    heights = numeric_grid(df.sparkSession, 0, last_height, step, "h")
    grid = wide.crossJoin(F.broadcast(heights))  # centres (4) x heights (205)

    def te(t, g):
        return H.temperature_at("h", t, g, "centre")

    return grid.select(
        "centre",
        "h",
        te("mean_v1_T0_Day", "mean_v1_G0_Day").alias("v1_day"),
        te("mean_v1_T0_Night", "mean_v1_G0_Night").alias("v1_night"),
        te("mean_T_ref_Day", "mean_best_G0_Day").alias("v2_day"),
        te("mean_T_ref_Night", "mean_best_G0_Night").alias("v2_night"),
    )


def height_sweep(params: DataFrame, first: int = 1000, last: int = 14900, step: int = 100) -> DataFrame:
    """Te over height for each (t0, g0, ilat) row; heights expand inside the row."""
    h = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)).cast("array<double>")).alias("h")
    return params.select("*", h).withColumn("te", H.temperature_at("h", "t0", "g0", "ilat"))


def parameter_sweep(spark: SparkSession, count: int = 21, step: float = 0.05) -> DataFrame:
    """Day and night T0 and G0 over s_L = 0, step, …"""
    s = spark.range(count).select((F.col("id") * F.lit(step)).alias("s_L"))
    return s.select("s_L", *sweep_columns("s_L"))


def sweep_columns(s: str) -> list[Column]:
    return [
        H.rational(s, H.COEFFICIENTS[part][which]).alias(f"{part}_{which}")
        for part in ("Day", "Night")
        for which in ("T0", "G0")
    ]
