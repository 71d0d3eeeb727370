"""Projections, schema checks, predicates, sentinel and null handling."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.catalog.base import INVALID_SQL, query, rnd, with_obs
from lagfield.operators import cleaning as V
from lagfield.plans.dataset import cleaning_steps

KEYS = ["okey", "line", "part"]
BASE = "okey, line, part"


@query("v1_projection_existing", with_obs(f"SELECT {BASE}, Altitude, Te1 FROM obs"))
def _(t):
    kept, _missing = V.keep_existing(t.obs, [*KEYS, "Altitude", "Te1", "NotThere"])
    return kept


@query("v2_schema_assertion", with_obs("SELECT ts, Altitude, Te1 FROM obs"))
def _(t):
    df = t.obs.select("ts", "Altitude", "Te1")
    V.require_columns(df, ["ts", "Altitude", "Te1"], exact=True)
    return V.require_types(df, {"ts": T.TimestampNTZType, "Te1": T.DoubleType})


@query("v3_add_missing_columns", with_obs(f"SELECT {BASE}, Te1, CAST(NULL AS DOUBLE) AS AL_index, CAST(NULL AS DOUBLE) AS SYM_H FROM obs"))
def _(t):
    return V.add_missing(t.obs.select(*KEYS, "Te1"), ["AL_index", "SYM_H", "Te1"])


@query("v4_column_order_rename", with_obs("SELECT ts AS DateTimeFormatted, Altitude, ILAT FROM obs"))
def _(t):
    return V.ordered(t.obs, ["DateTimeFormatted", "Altitude", "ILAT"], {"ts": "DateTimeFormatted"})


@query(
    "v5_sentinel_row_filter",
    with_obs(f"SELECT {BASE}, XXLAT, XXLON FROM obs WHERE NOT (coalesce(XXLAT = 999, false) OR coalesce(XXLON = 999, false))"),
)
def _(t):
    return V.drop_sentinel_rows(t.obs.select(*KEYS, "XXLAT", "XXLON"), ["XXLAT", "XXLON"])


@query("v6_upper_bound_filter", with_obs(f"SELECT {BASE}, ILAT FROM obs WHERE ILAT <= 90"))
def _(t):
    return t.obs.where(F.col("ILAT") <= 90).select(*KEYS, "ILAT")


@query(
    "v7_closed_range_filter",
    with_obs(f"SELECT {BASE}, Altitude, ILAT FROM obs WHERE Altitude BETWEEN 1000 AND 8000 AND ILAT BETWEEN 15 AND 55"),
)
def _(t):
    keep = F.col("Altitude").between(1000, 8000) & F.col("ILAT").between(15, 55)
    return t.obs.where(keep).select(*KEYS, "Altitude", "ILAT")


@query(
    "v8_date_lower_bound",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND o_orderdate >= TIMESTAMP '1997-01-01'",
)
def _(t):
    dated = t.orders.withColumn("d", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    keep = F.col("d").isNotNull() & (F.col("d") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return dated.where(keep).select("o_orderkey", "o_orderdate")


@query(
    "v9_time_window_and_complement",
    """SELECT CASE WHEN d >= TIMESTAMP '1998-01-31' AND d < TIMESTAMP '1998-02-07' THEN 'window' ELSE 'rest' END AS side,
       count(*) AS n, min(d) AS first_ts, max(d) AS last_ts, CAST(sum(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undated
       FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders) GROUP BY 1""",
)
def _(t):
    df = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    span = ("d", "1998-01-31", "1998-02-07")
    inside = df.where(V.in_window(*span)).withColumn("side", F.lit("window"))
    rest = df.where(V.outside_window(*span)).withColumn("side", F.lit("rest"))
    return inside.unionByName(rest).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("d").alias("first_ts"),
        F.max("d").alias("last_ts"),
        F.count_if(F.col("d").isNull()).alias("undated"),
    )


@query(
    "v10_inclusive_day_range",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-16'",
)
def _(t):
    return t.orders.where(V.in_days("o_orderdate", "1996-03-01", "1996-04-15")).select("o_orderkey", "o_orderdate")


@query("v11_nan_prediction_filter", with_obs(f"SELECT {BASE}, {rnd('sqrt(Te1 - 2000)')} AS root FROM obs WHERE Te1 >= 2000"))
def _(t):
    # A square root of a negative number is NaN here: those rows must go.
    df = t.obs.withColumn("raw", F.sqrt(F.col("Te1") - 2000)).where(V.present("raw"))
    return df.select(*KEYS, F.round("raw", 6).alias("root"))


PART_SQL = (
    "CASE WHEN hour(ts) BETWEEN 9 AND 15 THEN 'Day' WHEN hour(ts) >= 21 OR hour(ts) < 4 THEN 'Night' ELSE 'Transition' END"
)


@query(
    "v12_day_part_filter",
    with_obs(f"SELECT {BASE}, ts, {PART_SQL} AS day_part FROM obs WHERE {PART_SQL} IN ('Day', 'Night')"),
)
def _(t):
    from lagfield.functions.thermal import day_part

    df = t.obs.select(*KEYS, "ts", day_part("ts").alias("day_part"))
    return df.where(F.col("day_part").isin("Day", "Night"))


@query(
    "v13_local_time_sectors",
    with_obs(
        f"""SELECT {BASE}, 'day' AS sector, GMLT FROM obs WHERE GMLT > 10 AND GMLT < 17
        UNION ALL SELECT {BASE}, 'night', GMLT FROM obs WHERE GMLT > 22 OR GMLT < 4
        UNION ALL SELECT {BASE}, 'all', GMLT FROM obs"""
    ),
)
def _(t):
    return t.obs.select(*KEYS, F.explode(V.sectors("GMLT")).alias("sector"), "GMLT")


@query(
    "v14_finite_positive_filter",
    with_obs(f"SELECT {BASE}, XXLAT FROM obs WHERE XXLAT IS NOT NULL AND isfinite(XXLAT) AND XXLAT > 0"),
)
def _(t):
    return t.obs.where(V.finite("XXLAT") & (F.col("XXLAT") > 0)).select(*KEYS, "XXLAT")


@query(
    "v15_row_attrition_audit",
    with_obs(
        """, f AS (SELECT *, NOT (coalesce(XXLAT = 999, false) OR coalesce(XXLON = 999, false)) AS k1,
            coalesce(ILAT <= 90, false) AS k2, Altitude BETWEEN 1000 AND 8000 AS k3,
            ts >= TIMESTAMP '1996-01-01' AS k4,
            CAST(date_diff('day', TIMESTAMP '1970-01-01', ts) AS DOUBLE) AS day FROM obs),
        a AS (SELECT count(*) AS c0, count(*) FILTER (k1) AS c1, count(*) FILTER (k1 AND k2) AS c2,
            count(*) FILTER (k1 AND k2 AND k3) AS c3, count(*) FILTER (k1 AND k2 AND k3 AND k4) AS c4,
            min(GLAT) FILTER (k1) AS lo1, max(GLAT) FILTER (k1) AS hi1,
            min(ILAT) FILTER (k1 AND k2) AS lo2, max(ILAT) FILTER (k1 AND k2) AS hi2,
            min(Altitude) FILTER (k1 AND k2 AND k3) AS lo3, max(Altitude) FILTER (k1 AND k2 AND k3) AS hi3,
            min(day) FILTER (k1 AND k2 AND k3 AND k4) AS lo4, max(day) FILTER (k1 AND k2 AND k3 AND k4) AS hi4 FROM f)
        SELECT 1 AS step, 'no 999 in XXLAT or XXLON' AS description, c0 - c1 AS removed, c1 AS remaining, lo1 AS low, hi1 AS high FROM a
        UNION ALL SELECT 2, 'ILAT at most 90', c1 - c2, c2, lo2, hi2 FROM a
        UNION ALL SELECT 3, 'altitude 1000 to 8000 km', c2 - c3, c3, lo3, hi3 FROM a
        UNION ALL SELECT 4, 'dated 1996-01-01 or later', c3 - c4, c4, lo4, hi4 FROM a"""
    ),
)
def _(t):
    raw = t.obs.withColumn("DateFormatted", F.col("ts"))
    return V.attrition(raw, cleaning_steps("1996-01-01"))


# Placeholders planted at natural rows: line numbers decide which.
PLANTED = {
    "a": "CASE WHEN line = 1 THEN 999.9e0 WHEN line = 2 THEN 9999e0 ELSE Te1 END",
    "b": "CASE WHEN line = 3 THEN 99.9e0 WHEN line = 1 THEN 99999.99e0 ELSE Altitude END",
}


@query(
    "v16_sentinel_replacement",
    with_obs(
        f", p AS (SELECT flag, status, {PLANTED['a']} AS a, {PLANTED['b']} AS b FROM obs)"
        f" SELECT flag, status, CASE WHEN a IN {INVALID_SQL} THEN 0 ELSE a END AS a,"
        f" CASE WHEN b IN {INVALID_SQL} THEN 0 ELSE b END AS b FROM p"
    ),
)
def _(t):
    # Every numeric column is searched, so only text columns go along.
    df = t.obs.selectExpr("flag", "status", f"{PLANTED['a']} AS a", f"{PLANTED['b']} AS b")
    return V.replace_invalid(df)


@query(
    "v16_sentinel_report",
    with_obs(
        f", p AS (SELECT {PLANTED['a']} AS v FROM obs UNION ALL SELECT {PLANTED['b']} FROM obs)"
        f" SELECT v AS value, count(*) AS hits FROM p WHERE v IN {INVALID_SQL} GROUP BY 1"
    ),
)
def _(t):
    return V.count_invalid(t.obs.selectExpr(f"{PLANTED['a']} AS a", f"{PLANTED['b']} AS b"))


@query(
    "v17_sentinel_to_null",
    with_obs(
        f", p AS (SELECT {BASE}, {PLANTED['a']} AS a, {PLANTED['b']} AS b FROM obs)"
        f" SELECT {BASE}, CASE WHEN a NOT IN (999.9, 99999.99) THEN a END AS a,"
        " CASE WHEN b NOT IN (999.9, 99999.99) THEN b END AS b FROM p"
    ),
)
def _(t):
    df = t.obs.selectExpr(*KEYS, f"{PLANTED['a']} AS a", f"{PLANTED['b']} AS b")
    gone = (999.9, 99999.99)
    # Once on a column, once inside an array.
    listed = df.withColumn("b", F.transform(F.array("b"), lambda x: V.sentinel_to_null(x, gone)))
    return listed.withColumns({"a": V.sentinel_to_null("a", gone), "b": F.get("b", F.lit(0))})


@query(
    "v18_missing_data_policy",
    with_obs(f"SELECT {BASE}, XXLAT, Te1 FROM obs WHERE XXLAT IS NOT NULL"),
)
def _(t):
    return V.guard_missing(t.obs.select(*KEYS, "XXLAT", "Te1"), ["XXLAT", "Te1"], 50.0)


@query("v19_fill_remaining_with_zero", with_obs(f"SELECT {BASE}, coalesce(XXLAT, 0) AS XXLAT, coalesce(XXLON, 0) AS XXLON FROM obs"))
def _(t):
    df = t.obs.select(*KEYS, "XXLAT", F.array("XXLON").alias("XXLON"))
    return V.fill_zero(df, ["XXLAT", "XXLON"]).withColumn("XXLON", F.get("XXLON", F.lit(0)))


NUMBER_TEXT = "CASE WHEN line = 1 THEN 'n/a' WHEN line = 2 THEN '' WHEN line = 3 THEN ' 12.5 ' ELSE CAST(CAST(Altitude AS BIGINT) AS VARCHAR(20)) END"


@query("v20_numeric_coercion", with_obs(f"SELECT {BASE}, TRY_CAST(trim({NUMBER_TEXT}) AS DOUBLE) AS number FROM obs"))
def _(t):
    text = NUMBER_TEXT.replace("VARCHAR(20)", "STRING")
    return t.obs.selectExpr(*KEYS, f"{text} AS raw").select(*KEYS, V.to_number("raw").alias("number"))
