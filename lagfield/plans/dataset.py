"""From raw observations and index series to saved feature splits."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagfield.functions.timeops import combine_date_time, floor_minute
from lagfield.operators import cleaning as V
from lagfield.operators.bounded import settle
from lagfield.operators.keyed import with_row_key
from lagfield.operators.lags import (
    BROADCAST_BYTES,
    attach_lags,
    attach_lags_by_join,
    widen,
)
from lagfield.operators.sampling import cut_hash, hash_order, ranked, split_exact
from lagfield.schema import GRID_MISSING, INSTANT, INSTANT_SPEC, LAG_GROUPS, TIME
from lagfield.sources.publish import publish
from lagfield.sources.writers import write_chunks, write_in_files, write_split

EARLIEST = "1990-01-01"


def cleaning_steps(earliest: str = EARLIEST) -> list[tuple[str, Column, Column | str | None]]:
    """The row filters in order, each with the column whose range is reported (dates as
    days since 1970)."""
    date = F.col("DateFormatted")
    return [
        ("no 999 in XXLAT or XXLON", ~V.any_equals(["XXLAT", "XXLON"], 999.0), "GLAT"),
        ("ILAT at most 90", F.col("ILAT") <= 90, "ILAT"),
        ("altitude 1000 to 8000 km", F.col("Altitude").between(1000, 8000), "Altitude"),
        (
            f"dated {earliest} or later",
            date.isNotNull() & (date >= F.lit(earliest).cast("timestamp_ntz")),
            F.unix_date(date.cast("date")),
        ),
    ]


def clean(raw: DataFrame, earliest: str = EARLIEST) -> DataFrame:
    """Filtered observations with one minute-resolution time column.

    NaN must already be null (the scan does that). Rows whose clock does not parse
    stay, without a time.
    """
    df = raw
    for _, keep, _ in cleaning_steps(earliest):
        df = df.where(keep)
    df = df.withColumn(TIME, floor_minute(combine_date_time("DateFormatted", "TimeFormatted")))
    return df.drop("DateFormatted", "TimeFormatted", "Date", "Time")


def audit(raw: DataFrame, earliest: str = EARLIEST) -> DataFrame:
    return V.attrition(raw, cleaning_steps(earliest))


@dataclass(frozen=True)
class IndexSeries:
    """The three index tables, each with unique ``ts``."""

    minute: DataFrame  # ts, AL_index, SYM_H
    flux: DataFrame  # ts, f107_index
    kp: DataFrame  # ts, Kp_index


def add_index_features(
    df: DataFrame,
    series: IndexSeries,
    ts: str = TIME,
    method: str = "exact",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Lag arrays AL_index, SYM_H, f107_index and the scalar Kp_index.

    ``exact``: a missing instant gives null. ``nearest``: F10.7 and Kp take the
    nearest hour there is. ``exact_join``: as exact, by exploding the lags.
    """
    df = df.drop("AL_index", "SYM_H")
    sources = {"AL_index": series.minute, "SYM_H": series.minute, "f107_index": series.flux}
    if method in ("exact", "nearest"):
        groups = [(sources[g], "ts", g, g, spec) for g, spec in LAG_GROUPS.items()]
        groups.append((series.kp, "ts", INSTANT, INSTANT, INSTANT_SPEC))
        out = attach_lags(df, ts, groups, broadcast_bytes, ["f107_index", INSTANT] if method == "nearest" else [])
    elif method == "exact_join":
        out = df
        for g, spec in LAG_GROUPS.items():
            out = attach_lags_by_join(out, ts, sources[g], "ts", g, g, spec)
        out = attach_lags_by_join(out, ts, series.kp, "ts", INSTANT, INSTANT, INSTANT_SPEC)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn(INSTANT, F.get(INSTANT, F.lit(0)))


def mask_placeholders(df: DataFrame) -> DataFrame:
    """Placeholder readings to null in the lag arrays and Kp (grid path)."""
    fixed = {g: F.transform(g, lambda x: V.sentinel_to_null(x, GRID_MISSING)) for g in LAG_GROUPS}
    return df.withColumns({**fixed, INSTANT: V.sentinel_to_null(INSTANT, GRID_MISSING)})


def wide(df: DataFrame) -> DataFrame:
    """Lag arrays to numbered columns; the one place where the row becomes wide."""
    return widen(df, {g: s.count for g, s in LAG_GROUPS.items()})


def feature_table(df: DataFrame, series: IndexSeries, **kw) -> DataFrame:
    """Cleaned observations to the wide feature table with placeholders zeroed."""
    return wide(V.replace_invalid(add_index_features(df, series, **kw)))


def split_features(
    features: DataFrame, key: str, start: str, end: str, n_test: int, seed: int = 42, ts: str = TIME
) -> dict[str, DataFrame]:
    """Window hold-out, exact-size random test set, and the rest for training."""
    held = features.where(V.in_window(ts, start, end))
    rest = features.where(V.outside_window(ts, start, end))
    test, train = split_exact(rest, key, n_test, seed)
    return {"test-storm": held, "test-normal": test, "train": train}


def save_splits(
    splits: dict[str, DataFrame], base: str, key: str, chunk_rows: int = 250_000, numbered: bool = False
) -> None:
    """Write the hold-outs whole and the training rows in chunks."""
    for name in ("test-storm", "test-normal"):
        write_split(splits[name], base, name)
    path = f"{base}/train_chunks"
    if numbered:
        write_chunks(ranked(splits["train"], key, name="rank"), path, "rank", chunk_rows)
    else:
        write_in_files(splits["train"], path, chunk_rows)


class Saved(NamedTuple):
    """A saved table and the row attrition of the cleaning that led to it."""

    table: DataFrame
    audit: DataFrame


def clean_audited(raw: DataFrame, earliest: str = EARLIEST) -> Saved:
    """Cleaned observations with their row keys, written once, and the audit of the same pass over ``raw``.

    The audit's numbers are taken on the way. They are held against the rows that were
    written; if a lost executor made them differ, they are counted again from ``raw``.
    """
    steps = cleaning_steps(earliest)
    watched, seen = V.observed_attrition(raw, steps)
    keyed = settle(with_row_key(clean(watched, earliest)), "observations")
    spark = raw.sparkSession
    exact = seen.get.get(f"c{len(steps)}") == keyed.count()
    return Saved(keyed, V.attrition_of(spark, seen, steps) if exact else audit(raw, earliest))


def create_dataset(
    raw: DataFrame,
    series: IndexSeries,
    base: str,
    start: str,
    end: str,
    n_test: int,
    seed: int = 42,
    earliest: str = EARLIEST,
    chunk_rows: int = 250_000,
    **features,
) -> Saved:
    """Raw observations to saved feature splits under ``base``, each step once; the saved table and the cleaning's audit.

    Raw observations are read once. Rows get their key and their split while they are still narrow; features are attached to
    all splits in one pass and written once, in one folder for each split. The series are
    written before that, so their files are parsed once however many lag groups read them. The
    folder ``base`` is replaced as a whole: a job that fails leaves the old dataset.
    """
    keyed, counted = clean_audited(raw, earliest)
    rest = keyed.where(V.outside_window(TIME, start, end))
    cut = cut_hash(rest, "row_key", n_test, seed)
    normal = F.lit(True) if cut is None else hash_order("row_key", seed) <= cut
    name = F.when(V.in_window(TIME, start, end), "test-storm").when(normal, "test-normal").otherwise("train")
    ready = IndexSeries(*(settle(s, n) for s, n in ((series.minute, "minute"), (series.flux, "flux"), (series.kp, "kp"))))
    table = feature_table(keyed.withColumn("split", name), ready, **features)
    publish(raw.sparkSession, base, table.write.option("maxRecordsPerFile", chunk_rows).partitionBy("split").parquet)
    return Saved(raw.sparkSession.read.schema(table.schema).parquet(base), counted)


def load_series(spark: SparkSession, minute: str, flux: str, kp: str, mask: bool = False) -> IndexSeries:
    from lagfield.sources import readers as R

    return IndexSeries(
        R.scan_minute_indices(spark, minute, mask), R.scan_flux(spark, flux, mask), R.scan_kp(spark, kp, mask)
    )
