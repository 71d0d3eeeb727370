"""Registry of named queries and the stand-in columns they run on.

The test tables are not satellite data, so columns with the right ranges, gaps and
placeholders are derived from them. Derivations are SQL text that Spark and DuckDB
read alike; the operators under test are written separately for each side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lagfield.schema import INVALID_VALUES
from lagfield.session import configure


@dataclass(frozen=True)
class Entry:
    run: Callable[["Tables"], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return register


# Observation-like columns of lineitem (whole table).
LINE_OBS = {
    "okey": "l_orderkey",
    "line": "l_linenumber",
    "part": "l_partkey",
    "flag": "l_returnflag",
    "status": "l_linestatus",
    "Altitude": "CAST(500 + (l_partkey * 37 + l_linenumber * 411) % 8501 AS DOUBLE)",
    "GCLAT": "CAST((l_partkey * 11 + l_linenumber) % 181 - 90 AS DOUBLE)",
    "GCLON": "CAST((l_suppkey * 29 + l_linenumber * 7) % 361 AS DOUBLE)",
    "ILAT": "CAST((l_suppkey * 7 + l_partkey * 3 + l_linenumber * 13) % 97 AS DOUBLE)",
    "GLAT": "CAST((l_partkey * 13 + l_suppkey) % 161 - 80 AS DOUBLE)",
    "GMLT": "CAST((l_orderkey * 5 + l_linenumber) % 96 AS DOUBLE) / 4",
    "XXLAT": "CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 999e0 WHEN l_tax = 0 THEN NULL"
    " ELSE CAST((l_partkey * 17 + l_linenumber) % 181 - 90 AS DOUBLE) END",
    "XXLON": "CASE WHEN l_linenumber = 1 AND l_discount > 9e-2 THEN 999e0"
    " ELSE CAST((l_orderkey * 3 + l_suppkey) % 361 AS DOUBLE) END",
    "Te1": "l_extendedprice / 97e-1",
    "Kp_index": "CAST((l_orderkey + l_linenumber) % 91 AS DOUBLE)",
    "qty": "l_quantity",
    "tax": "l_tax",
    "discount": "l_discount",
    "ts": "l_shipdate + ((l_orderkey * 7 + l_linenumber * 13) % 1440) * INTERVAL '1' MINUTE",
    "pred": "l_quantity * 200 + l_tax * 1000",
}

# Observation times: purchases, with positions taken from their ids.
EVENT_OBS = {
    "event_id": "event_id",
    "t": "date_trunc('minute', ts)",
    "Altitude": "CAST(1000 + (event_id * 37) % 7001 AS DOUBLE)",
    "GCLAT": "CAST(user_id % 181 - 90 AS DOUBLE)",
    "GCLON": "CAST((event_id * 29) % 361 AS DOUBLE)",
    "ILAT": "CAST((event_id * 7) % 90 AS DOUBLE)",
    "GLAT": "CAST((event_id * 13) % 161 - 80 AS DOUBLE)",
    "GMLT": "CAST((event_id * 5) % 96 AS DOUBLE) / 4",
    "XXLAT": "CAST((event_id * 17) % 181 - 90 AS DOUBLE)",
    "XXLON": "CAST((event_id * 3) % 361 AS DOUBLE)",
    "Te1": "value * 21e0 / 97e-1",
}

OBS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LINE_OBS.items()) + " FROM lineitem"
PURCHASE_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVENT_OBS.items()) + " FROM events WHERE event_type = 'purchase'"
)
# Minute series (AL-like from clicks and views, SYM-H-like from errors) and hourly
# series with natural gaps (rare high readings).
MINUTE_SQL = (
    "SELECT date_trunc('minute', ts) AS ts,"
    " max(CASE WHEN event_type IN ('click', 'view') THEN 0 - value END) AS AL_index,"
    " min(CASE WHEN event_type = 'error' THEN 1e2 - value END) AS SYM_H"
    " FROM events WHERE event_type <> 'purchase' GROUP BY 1"
)
FLUX_SQL = (
    "SELECT date_trunc('hour', ts) AS ts, max(value) AS f107_index"
    " FROM events WHERE event_type = 'view' AND value > 60 GROUP BY 1"
)
KP_SQL = (
    "SELECT date_trunc('hour', ts) AS ts, min(value) / 2 AS Kp_index"
    " FROM events WHERE event_type = 'signup' AND value > 80 GROUP BY 1"
)


class Tables:
    """The given tables of one directory, and stand-ins derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        import re

        names = re.findall(r"FROM (\w+)", text)
        frames = {n: getattr(self, n) for n in names}
        for n in names:
            text = text.replace(f"FROM {n}", "FROM {" + n + "}")
        return self.spark.sql(text, **frames)

    @cached_property
    def obs(self) -> DataFrame:
        return self.lineitem.selectExpr(*[f"{e} AS {n}" for n, e in LINE_OBS.items()])

    @cached_property
    def purchases(self) -> DataFrame:
        df = self.events.where("event_type = 'purchase'")
        return df.selectExpr(*[f"{e} AS {n}" for n, e in EVENT_OBS.items()]).withColumn(
            "t", _ntz("t")
        )

    @cached_property
    def minute_series(self) -> DataFrame:
        return self._sql(MINUTE_SQL).withColumn("ts", _ntz("ts"))

    @cached_property
    def flux_series(self) -> DataFrame:
        return self._sql(FLUX_SQL).withColumn("ts", _ntz("ts"))

    @cached_property
    def kp_series(self) -> DataFrame:
        return self._sql(KP_SQL).withColumn("ts", _ntz("ts"))


def _ntz(c: str):
    from pyspark.sql import functions as F

    return F.col(c).cast("timestamp_ntz")


# -- SQL text helpers for the oracle side -----------------------------------

INVALID_SQL = f"({', '.join(map(repr, INVALID_VALUES))})"


def with_obs(body: str) -> str:
    return f"WITH obs AS ({OBS_SQL}) {body}"


def with_series(body: str) -> str:
    return (
        f"WITH obs AS ({PURCHASE_SQL}), minute_series AS ({MINUTE_SQL}), flux AS ({FLUX_SQL}), kp AS ({KP_SQL}) {body}"
    )


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def clean_number(expr: str, digits: int = 6) -> str:
    """Rounded; NaN and infinities as null."""
    return f"CASE WHEN isfinite({expr}) THEN {rnd(expr, digits)} END"


def half_even_hour(ts: str) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_hours(CAST(round_even(epoch_us({ts}) / 3600000000.0, 0) AS INTEGER)))"


def bin_of(x: str, lo: str, hi: str, n: int) -> str:
    """Equal-width bin with closed last bin and edge correction, null outside."""
    g = f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}), {n - 1})"
    w = f"(({hi} - {lo}) / {n})"
    return (
        f"CAST(CASE WHEN {x} < {lo} OR {x} > {hi} THEN NULL"
        f" WHEN {x} < {lo} + {g} * {w} THEN {g} - 1"
        f" WHEN {x} >= {lo} + ({g} + 1) * {w} AND {g} < {n - 1} THEN {g} + 1 ELSE {g} END AS INTEGER)"
    )
