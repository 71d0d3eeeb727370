"""Time x altitude grids carrying index features and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.functions import geometry as G
from lagfield.functions.timeops import numeric_grid
from lagfield.operators.cleaning import guard_missing, ordered
from lagfield.plans.dataset import IndexSeries, add_index_features, mask_placeholders, wide
from lagfield.schema import TIME, feature_columns

# Constant columns of the plain grid.
PLAIN_FIXED = {"ILAT": 45.0, "GMLT": 0.0, "XXLAT": 0.0, "XXLON": 0.0, "GCLAT": 0.0, "GCLON": 0.0}
# Field line and foot point of the anchored grid.
ANCHOR_SHELL, ANCHOR_LATITUDE, ANCHOR_LONGITUDE = 3.0, 43.0, 289.0


GRID_ROWS_PER_TASK = 250_000


def spread_times(times: DataFrame, ts: str, altitudes: int) -> DataFrame:
    """Times over enough tasks for what each of them grows into.

    The time table is tiny, so adaptive execution would leave it in one partition and
    one task would build the whole grid. An explicit partition count is kept as it is.
    """
    tasks = max(1, -(-times.count() * altitudes // GRID_ROWS_PER_TASK))
    return times.repartition(tasks, ts)


def time_altitude_grid(times: DataFrame, ts: str, low: int = 1000, high: int = 8000, step: int = 10) -> DataFrame:
    """Every time with every altitude; the altitude list is fixed and broadcast."""
    alt = numeric_grid(times.sparkSession, low, high, step, "Altitude")
    times = spread_times(times, ts, len(range(low, high + 1, step)))
    return times.select(F.col(ts).alias(TIME)).crossJoin(F.broadcast(alt))


def features_onto_grid(grid: DataFrame, features: DataFrame, ts: str) -> DataFrame:
    """Features of each time (unique in ``features``) on all its grid rows.

    The feature side is broadcast by Spark while it is small in bytes; otherwise both sides
    shuffle on the time, and a time is one altitude list, so no key is hot.
    """
    return grid.join(features.withColumnRenamed(ts, TIME), TIME, "left")


def plain_grid(
    times: DataFrame, ts: str, series: IndexSeries, low: int = 1000, high: int = 8000, step: int = 10
) -> DataFrame:
    """Wide grid table: features once per time, then times x altitudes, then columns
    that depend on altitude. The features never repeat in a shuffle: the cross join
    with the broadcast altitudes runs after they are attached."""
    times = spread_times(times.select(F.col(ts).alias(TIME)), TIME, len(range(low, high + 1, step)))
    features = mask_placeholders(add_index_features(times, series, method="nearest"))
    alt = numeric_grid(times.sparkSession, low, high, step, "Altitude")
    grid = wide(features).crossJoin(F.broadcast(alt))
    fixed = {c: F.lit(v) for c, v in PLAIN_FIXED.items()}
    grid = grid.withColumns({"GLAT": G.grid_latitude("Altitude"), **fixed})
    return ordered(grid, [TIME, *feature_columns()])


def anchored_grid(
    times: DataFrame,
    ts: str,
    sm_longitude: str,
    series: IndexSeries,
    low: int = 1000,
    high: int = 8000,
    step: int = 10,
    threshold_percent: float = 5.0,
) -> DataFrame:
    """Grid on one field line. ``times`` carries the foot point's SM longitude (degrees)
    per time; local time and dipole position follow from it. Latitudes in other frames
    (GLAT, XXLAT, XXLON) may be supplied as columns of ``times``; the dipole latitude
    stands in for GLAT otherwise. Rows missing a feature are dropped, and the job fails
    when more than the threshold is missing."""
    base = spread_times(times.withColumnRenamed(ts, TIME), TIME, len(range(low, high + 1, step)))
    features = wide(mask_placeholders(add_index_features(base, series, method="nearest")))
    # Every time meets every altitude, so shares per time equal shares per grid row;
    # the check runs before the cross join, on a table smaller by the altitude count.
    inputs = [c for c in [*feature_columns(), sm_longitude] if c in features.columns]
    features = guard_missing(features, inputs, threshold_percent)
    alt = numeric_grid(times.sparkSession, low, high, step, "Altitude")
    grid = features.crossJoin(F.broadcast(alt))
    pos = G.dipole_position("Altitude", F.lit(ANCHOR_SHELL), sm_longitude)
    grid = grid.withColumns(
        {
            **pos,
            "GMLT": G.magnetic_local_time(sm_longitude),
            "ILAT": G.ilat_of_l(F.lit(ANCHOR_SHELL)),
            "GCLAT": F.lit(ANCHOR_LATITUDE),
            "GCLON": F.lit(ANCHOR_LONGITUDE),
        }
    )
    stand_in = {"GLAT": F.degrees("mag_lat_rad"), "XXLAT": F.lit(ANCHOR_LATITUDE), "XXLON": F.lit(ANCHOR_LONGITUDE)}
    return grid.withColumns({c: e for c, e in stand_in.items() if c not in grid.columns})
