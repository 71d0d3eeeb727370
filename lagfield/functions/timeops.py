"""Timestamp parsing, flooring, rounding and grids.

Times are ``timestamp_ntz`` holding UTC; the session zone must be UTC (see
``session.configure``) so that epoch arithmetic is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.schema import MICROS_PER_HOUR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us) -> Column:
    return F.timestamp_micros(_c(us)).cast("timestamp_ntz")


def lenient_timestamp(text, fmt: str | None = None) -> Column:
    """Parse text; anything unparsable becomes null."""
    text = _c(text)
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return parsed.cast("timestamp_ntz")


def combine_date_time(date, time_text) -> Column:
    """Calendar date plus a clock string; null when either is missing or bad."""
    day = F.date_format(_c(date), "yyyy-MM-dd")
    return lenient_timestamp(F.concat(day, F.lit(" "), _c(time_text)))


def floor_minute(ts) -> Column:
    return F.date_trunc("minute", _c(ts).cast("timestamp")).cast("timestamp_ntz")


def day_of_year_timestamp(year, doy, hour=None, minute=None) -> Column:
    """Year and day-of-year (1..366) with optional clock parts; null if out of range.

    Arguments may be fractional text casts, so they are tested before narrowing.
    """
    y, d = _c(year), _c(doy)
    h = _c(hour) if hour is not None else F.lit(0)
    m = _c(minute) if minute is not None else F.lit(0)
    legal = y.between(1, 9999) & d.between(1, 366)
    first = F.make_date(F.when(legal, y).cast("int"), F.lit(1), F.lit(1))
    day = F.date_add(first, (F.when(legal, d) - 1).cast("int"))
    clock = F.make_dt_interval(F.lit(0), h.cast("int"), m.cast("int"))
    return day.cast("timestamp_ntz") + clock


def half_even_index(us, unit_us: int) -> Column:
    """Grid number nearest to ``us`` microseconds, an exact half going to the even one.

    Pure integer arithmetic, so it is exact for any instant.
    """
    us = _c(us)
    rest = F.pmod(us, F.lit(unit_us))
    low = F.call_function("div", us - rest, F.lit(unit_us))
    twice = rest * 2
    return (
        F.when(twice < unit_us, low)
        .when(twice > unit_us, low + 1)
        .otherwise(low + F.pmod(low, F.lit(2)))
    )


def round_hour(ts) -> Column:
    """Nearest full hour; xx:30 exactly goes to the even hour."""
    return from_micros(half_even_index(micros(ts), MICROS_PER_HOUR) * F.lit(MICROS_PER_HOUR))


def hour(ts) -> Column:
    return F.hour(_c(ts))


def year(ts) -> Column:
    return F.year(_c(ts))


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def day_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def minus_minutes(ts, minutes) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else _c(minutes)
    return _c(ts) - F.make_dt_interval(mins=minutes.cast("int"))


def time_grid(spark: SparkSession, start: str, end: str, step_minutes: int, name: str = "ts") -> DataFrame:
    """Instants ``start, start+step, …`` strictly before ``end``, spread over tasks."""
    bounds = spark.sql(
        f"SELECT unix_micros(TIMESTAMP '{start}') AS a, unix_micros(TIMESTAMP '{end}') AS b"
    ).first()
    step = step_minutes * 60_000_000
    n = max(0, -(-(bounds.b - bounds.a) // step))
    return spark.range(n).select(from_micros(F.lit(bounds.a) + F.col("id") * F.lit(step)).alias(name))


def span_grid(ts_df: DataFrame, col: str, step_minutes: int, name: str = "ts") -> DataFrame:
    """Grid covering the span of a column, first value's grid point to the last's.

    Driven by a one-row aggregate; the generator expands it inside Spark.
    """
    step = step_minutes * 60_000_000
    ends = ts_df.agg(F.min(micros(col)).alias("a"), F.max(micros(col)).alias("b"))
    index = F.sequence(
        F.floor(F.col("a") / step).cast("bigint"), F.floor(F.col("b") / step).cast("bigint")
    )
    return ends.where(F.col("a").isNotNull()).select(F.explode(index).alias("i")).select(
        from_micros(F.col("i") * F.lit(step)).alias(name)
    )


def numeric_grid(spark: SparkSession, start: int, last: int, step: int, name: str) -> DataFrame:
    """``start, start+step, …`` up to and including ``last``, as doubles."""
    return spark.range(start, last + 1, step).select(F.col("id").cast("double").alias(name))
