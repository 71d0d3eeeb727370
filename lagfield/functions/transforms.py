"""Feature scaling, target classes and class-probability outputs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagfield.schema import BIN_COUNT, BIN_WIDTH


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def not_nan(x) -> Column:
    """NaN counts as missing everywhere in this package."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def altitude_scale(x) -> Column:
    return (_c(x) - 4000.0) / 4000.0


def latitude_scale(x) -> Column:
    return _c(x) / 90.0


def longitude_wave(x) -> Column:
    return F.sin(F.radians(_c(x)))


def local_time_wave(x) -> Column:
    return F.sin(_c(x) * F.pi() / 12.0)


def kp_scale(x) -> Column:
    return _c(x) / 45.0 - 1.0


# Which scaling each input column gets.
SCALERS = {
    "Altitude": altitude_scale,
    "GCLAT": latitude_scale,
    "GCLON": longitude_wave,
    "ILAT": latitude_scale,
    "GLAT": latitude_scale,
    "GMLT": local_time_wave,
    "XXLAT": latitude_scale,
    "XXLON": longitude_wave,
    "Kp_index": kp_scale,
}


def z_score(x, mean, std) -> Column:
    """(x - mean) / std; x unchanged where std is zero or missing.

    ``mean`` and ``std`` are numbers or columns.
    """
    x = _c(x)
    if not isinstance(std, Column):
        return (x - F.lit(mean)) / F.lit(float(std)) if std else x
    usable = std.isNotNull() & (std != 0)
    return F.when(usable, (x - mean) / F.nullif(std, F.lit(0.0))).otherwise(x)


def z_score_array(values, mean, std) -> Column:
    """Group z-score of a lag array with one mean and std for the whole group."""
    return F.transform(_c(values), lambda x: z_score(x, mean, std))


def unscale_mean(x, mean: float, std: float) -> Column:
    return _c(x) * F.lit(std) + F.lit(mean)


def unscale_variance(v, std: float) -> Column:
    return _c(v) * F.lit(std * std)


def group_of(name) -> Column:
    """Column name to lag-group name: a trailing ``_<digits>`` is dropped."""
    return F.regexp_replace(_c(name), "_[0-9]+$", "")


def target_class(x, width: int = BIN_WIDTH, classes: int = BIN_COUNT) -> Column:
    """Class of a value, limited to the first and last; a missing value (null or NaN) has none."""
    x = _c(x).cast("double")
    inner = F.greatest(F.lit(0), F.least(F.lit(classes - 1), F.floor(x / F.lit(float(width))))).cast("int")
    return F.when(x.isNotNull() & ~F.isnan(x), inner)


def class_centre(k, width: int = BIN_WIDTH) -> Column:
    return _c(k) * F.lit(width) + F.lit(width // 2)


def best_class(scores) -> Column:
    """Index of the largest score, the first one on ties."""
    a = _c(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def _spread(value: Column, like: Column) -> Column:
    # One evaluation per row: a scalar used inside a lambda would be re-evaluated per element.
    return F.array_repeat(value, F.size(like))


def softmax(scores) -> Column:
    a = _c(scores)
    shifted = F.zip_with(a, _spread(F.array_max(a), a), lambda x, m: F.exp(x - m))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(shifted, _spread(total, a), lambda x, s: x / s)


def entropy(probabilities) -> Column:
    return -F.aggregate(_c(probabilities), F.lit(0.0), lambda s, p: s + p * F.ln(p + F.lit(1e-10)))


def confidence(probabilities) -> Column:
    return F.array_max(_c(probabilities)) * 100.0


def cross_entropy(scores, label) -> Column:
    """-log softmax(scores)[label], in the overflow-safe log-sum-exp form."""
    a = _c(scores)
    top = F.array_max(a)
    mass = F.aggregate(
        F.zip_with(a, _spread(top, a), lambda x, m: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x
    )
    return top + F.ln(mass) - F.get(a, _c(label).cast("int"))


def nearest_centre(x, centres, low: float = 0.0, high: float = 90.0) -> Column:
    """Closest of a short fixed list, the lower one on ties; null outside [low, high)."""
    x = _c(x)
    ranked = F.array_min(
        F.array(*[F.struct(F.abs(F.lit(float(c)) - x).alias("d"), F.lit(float(c)).alias("c")) for c in centres])
    )
    return F.when((x >= low) & (x < high), ranked["c"])


def deviation(predicted, observed) -> Column:
    return _c(predicted) - _c(observed)


def residual(observed, predicted) -> Column:
    return _c(observed) - _c(predicted)


def kp_display(x) -> Column:
    return _c(x) / 10.0


def with_scaling(df, scalers: Mapping = SCALERS):
    """Apply every scaler whose column is present, in one projection."""
    present = {c: f(c) for c, f in scalers.items() if c in df.columns}
    return df.withColumns(present) if present else df
