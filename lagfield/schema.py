"""Names, lag layouts and fixed values shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class LagSpec:
    """``count`` look-backs, ``step`` units apart, on a grid of ``unit_us``.

    ``half_even`` rounds each looked-up instant to the nearest grid point (ties
    to the even one); otherwise only an exact hit on the grid counts.
    """

    unit_us: int
    step: int
    count: int
    half_even: bool = False

    @property
    def span(self) -> int:
        return self.step * (self.count - 1)


TIME = "DateTimeFormatted"
TARGET = "Te1"
POSITION = ("Altitude", "GCLAT", "GCLON", "ILAT", "GLAT", "GMLT", "XXLAT", "XXLON")
SIDE_CHANNELS = ("Ne1", "Pv1", "Te2", "Ne2", "Pv2", "Te3", "Ne3", "Pv3", "I1", "I2", "I3")

LAG_GROUPS = {
    "AL_index": LagSpec(MICROS_PER_MINUTE, 10, 31),
    "SYM_H": LagSpec(MICROS_PER_MINUTE, 30, 145),
    "f107_index": LagSpec(MICROS_PER_HOUR, 24, 4, half_even=True),
}
INSTANT = "Kp_index"
INSTANT_SPEC = LagSpec(MICROS_PER_HOUR, 1, 1, half_even=True)

# Placeholders that mark a missing reading in the feature table.
INVALID_VALUES = (99.9, 999.9, 9.999, 9999.0, 9999.99, 99999.99, 9999999.0)
# Placeholders turned to null on the grid path and at file scan.
GRID_MISSING = (999.9, 99999.99)
SCAN_MISSING = (9999.0, 99999.0, 999.9, 99999.99)

# Percentiles of the descriptive table.
DESCRIBE_PERCENTILES = (0.005, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995, 0.999)

# Classes of the target and how a class decodes to kelvin.
BIN_WIDTH = 100
BIN_COUNT = 150

# Thresholds of the accuracy report.
ABSOLUTE_THRESHOLDS = (100, 200, 300, 500, 1000, 2000, 5000)
RELATIVE_THRESHOLDS = (5, 10, 15, 20)


def lag_columns(group: str, spec: LagSpec | None = None) -> list[str]:
    spec = spec or LAG_GROUPS[group]
    return [f"{group}_{i}" for i in range(spec.count)]


def feature_columns() -> list[str]:
    """The model inputs in their fixed order: position, lags, instantaneous Kp."""
    lagged = [c for g in LAG_GROUPS for c in lag_columns(g)]
    return [*POSITION, *lagged, INSTANT]


def observation_schema() -> T.StructType:
    """Reader schema of the tab-separated observation file (by-name columns)."""
    text = [T.StructField(c, T.StringType()) for c in ("DateFormatted", "TimeFormatted", "Date", "Time")]
    numbers = [T.StructField(c, T.DoubleType()) for c in (*POSITION, TARGET, *SIDE_CHANNELS)]
    return T.StructType(text + numbers)


def feature_schema() -> T.StructType:
    numbers = [T.StructField(c, T.DoubleType()) for c in (*feature_columns(), TARGET)]
    return T.StructType([T.StructField(TIME, T.TimestampNTZType()), *numbers])
