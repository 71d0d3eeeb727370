"""Lag gathers, nearest look-ups, grids and key joins."""

from pyspark.sql import functions as F

from lagfield.catalog.base import half_even_hour, query, with_series
from lagfield.operators import lags as J
from lagfield.operators.keyed import attach_by_key, per_distinct
from lagfield.plans.synthetic import features_onto_grid, time_altitude_grid
from lagfield.schema import INSTANT_SPEC, LAG_GROUPS, MICROS_PER_HOUR, LagSpec


def gather_sql(group: str, column: str, series: str, spec: LagSpec) -> str:
    """Long form of an exact gather: one row per observation and lag."""
    unit = "to_hours" if spec.unit_us == MICROS_PER_HOUR else "to_minutes"
    at = f"(o.t - {unit}(CAST(k * {spec.step} AS INTEGER)))"
    if spec.half_even:
        at = half_even_hour(at)
    return (
        f"SELECT o.event_id, '{group}' AS grp, CAST(k AS INTEGER) AS lag, s.{column} AS value"
        f" FROM obs o CROSS JOIN (SELECT unnest(range({spec.count})) AS k) LEFT JOIN {series} s ON s.ts = {at}"
    )


def _long(df, group):
    return df.select("event_id", F.lit(group).alias("grp"), F.posexplode(group).alias("lag", "value"))


@query(
    "j1_lag_gather_exact",
    with_series(
        gather_sql("AL_index", "AL_index", "minute_series", LAG_GROUPS["AL_index"])
        + " UNION ALL "
        + gather_sql("SYM_H", "SYM_H", "minute_series", LAG_GROUPS["SYM_H"])
    ),
)
def _(t):
    groups = [(t.minute_series, "ts", g, g, LAG_GROUPS[g]) for g in ("AL_index", "SYM_H")]
    got = J.attach_lags(t.purchases.select("event_id", "t"), "t", groups)
    both = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("v")) for g in ("AL_index", "SYM_H")])
    return got.select("event_id", F.inline(both)).select("event_id", "grp", F.posexplode("v").alias("lag", "value"))


@query(
    "j1_lag_gather_unpacked",
    with_series(gather_sql("AL_index", "AL_index", "minute_series", LAG_GROUPS["AL_index"])),
)
def _(t):
    # Same result with the packed series treated as too large to broadcast.
    groups = [(t.minute_series, "ts", "AL_index", "AL_index", LAG_GROUPS["AL_index"])]
    return _long(J.attach_lags(t.purchases.select("event_id", "t"), "t", groups, broadcast_bytes=0), "AL_index")


@query(
    "j1_lag_gather_by_join",
    with_series(
        gather_sql("AL_index", "AL_index", "minute_series", LAG_GROUPS["AL_index"])
        + " UNION ALL "
        + gather_sql("SYM_H", "SYM_H", "minute_series", LAG_GROUPS["SYM_H"])
    ),
)
def _(t):
    rows = t.purchases.select("event_id", "t")
    al, sym = (
        _long(J.attach_lags_by_join(rows, "t", t.minute_series, "ts", g, g, LAG_GROUPS[g]), g) for g in ("AL_index", "SYM_H")
    )
    return al.unionByName(sym)


@query("j2_lag_gather_rounded", with_series(gather_sql("f107_index", "f107_index", "flux", LAG_GROUPS["f107_index"])))
def _(t):
    groups = [(t.flux_series, "ts", "f107_index", "f107_index", LAG_GROUPS["f107_index"])]
    return _long(J.attach_lags(t.purchases.select("event_id", "t"), "t", groups), "f107_index")


@query(
    "j3_instant_rounded_lookup",
    with_series(f"SELECT o.event_id, kp.Kp_index FROM obs o LEFT JOIN kp ON kp.ts = {half_even_hour('o.t')}"),
)
def _(t):
    rows = t.purchases.select("event_id", "t")
    return J.attach_instant(rows, "t", t.kp_series, "ts", "Kp_index", "Kp_index", INSTANT_SPEC).drop("t")


# Nearest key: the last one at or before and the first one at or after, tie to later.
NEAREST = """
 SELECT {keys}, CASE WHEN a.ts IS NULL THEN b.ts WHEN b.ts IS NULL THEN a.ts
   WHEN o.t - a.ts < b.ts - o.t THEN a.ts ELSE b.ts END AS key_ts,
   CASE WHEN a.ts IS NULL THEN b.v WHEN b.ts IS NULL THEN a.v
   WHEN o.t - a.ts < b.ts - o.t THEN a.v ELSE b.v END AS value
 FROM {rows} o ASOF LEFT JOIN {series} a ON o.t >= a.ts ASOF LEFT JOIN {series} b ON o.t <= b.ts
"""


@query(
    "j4_nearest_lookup",
    "WITH s AS (SELECT date_trunc('minute', ts) AS ts, min(value) AS v FROM events WHERE event_type = 'signup' AND value > 20 GROUP BY 1),"
    " o AS (SELECT event_id, date_trunc('minute', ts) AS t FROM events WHERE event_type <> 'signup')"
    + NEAREST.format(keys="o.event_id", rows="o", series="s"),
)
def _(t):
    ev = t.events.withColumn("t", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    series = ev.where("event_type = 'signup' AND value > 20").groupBy("t").agg(F.min("value").alias("v"))
    rows = ev.where("event_type <> 'signup'").select("event_id", "t")
    got = J.attach_nearest(rows, "t", series, "t", "v", "value", key_out="key_ts")
    return got.drop("t")


@query(
    "j4_nearest_lag_gather",
    with_series(
        ", r AS (SELECT event_id, CAST(k AS INTEGER) AS lag, "
        + half_even_hour("(obs.t - to_hours(CAST(k * 24 AS INTEGER)))")
        + " AS t FROM obs CROSS JOIN (SELECT unnest(range(4)) AS k)), s AS (SELECT ts, f107_index AS v FROM flux)"
        " SELECT event_id, lag, value FROM (" + NEAREST.format(keys="o.event_id, o.lag", rows="r", series="s") + ")"
    ),
)
def _(t):
    rows = t.purchases.select("event_id", "t")
    spec = LAG_GROUPS["f107_index"]
    got = J.attach_nearest_lags(rows, "t", t.flux_series, "ts", "f107_index", "v", spec)
    return got.select("event_id", F.posexplode("v").alias("lag", "value"))


HOURS_SQL = "SELECT DISTINCT date_trunc('hour', ts) AS h FROM events"


def _hours(t):
    return t.events.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("h")).distinct()


@query(
    "j5_grid_cross_join",
    f"SELECT h AS DateTimeFormatted, CAST(a AS DOUBLE) AS Altitude FROM ({HOURS_SQL}), (SELECT unnest(range(1000, 8001, 10)) AS a)",
)
def _(t):
    return time_altitude_grid(_hours(t), "h")


@query(
    "j6_features_onto_grid",
    with_series(
        f"SELECT h AS DateTimeFormatted, CAST(a AS DOUBLE) AS Altitude, kp.Kp_index FROM ({HOURS_SQL})"
        " CROSS JOIN (SELECT unnest(range(1000, 8001, 10)) AS a) LEFT JOIN kp ON kp.ts = h"
    ),
)
def _(t):
    return features_onto_grid(time_altitude_grid(_hours(t), "h"), t.kp_series, "ts")


@query(
    "j7_per_distinct_time",
    "SELECT event_id, hour(ts) * 15 % 360 / 15e0 AS sector, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS label FROM events",
)
def _(t):
    rows = t.events.select("event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("h"))
    costly = {"sector": F.hour("h") * 15 % 360 / F.lit(15.0), "label": F.date_format("h", "yyyy-MM-dd HH")}
    return per_distinct(rows, "h", costly).drop("h")


@query("j8_attach_scored_column", "SELECT o_orderkey, o_totalprice, round(o_totalprice / 100) * 100 AS guess FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    scored = t.orders.select("o_orderkey", (F.round(F.col("o_totalprice") / 100) * 100).alias("guess"))
    return attach_by_key(rows, scored, ["o_orderkey"])
