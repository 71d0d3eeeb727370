"""Scalar functions: date and time, feature scaling, model outputs, geometry, physics."""

from pyspark.sql import functions as F

from lagfield.catalog.base import clean_number, half_even_hour, query, rnd, with_obs
from lagfield.functions import geometry as G
from lagfield.functions import thermal as H
from lagfield.functions import timeops as C
from lagfield.functions import transforms as M

KEYS = ["okey", "line", "part"]
BASE = "okey, line, part"


def real(expr, digits=6):
    """Rounded, with NaN and infinities as null."""
    return F.when(~F.isnan(expr) & (F.abs(expr) < float("inf")), F.round(expr, digits) + 0.0)


def scalar(name: str, sql: dict[str, str], columns: dict, digits: int = 6, numeric: bool = True):
    """A query computing columns next to the row keys of the observation stand-in."""
    wrap = (lambda e: clean_number(e, digits)) if numeric else (lambda e: e)
    text = ", ".join(f"{wrap(e)} AS {n}" for n, e in sql.items())

    @query(name, with_obs(f"SELECT {BASE}, {text} FROM obs"))
    def _(t):
        cols = [(real(c(), digits) if numeric else c()).alias(n) for n, c in columns.items()]
        return t.obs.select(*KEYS, *cols)


# -- date and time -----------------------------------------------------------

# Dates as text, some of them broken, from the order date.
DATE_TEXT = "CASE WHEN o_orderstatus = 'P' THEN 'bad date' WHEN o_orderpriority = '5-LOW' THEN '1998-13-45' ELSE {} END"
SPARK_DAY, DUCK_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"
CLOCK_TEXT = "CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE {} END"
SPARK_CLOCK = "format_string('%02d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, o_custkey % 60)"
DUCK_CLOCK = "format('{:02d}:{:02d}:{:02d}', o_orderkey % 24, o_orderkey % 60, o_custkey % 60)"


@query(
    "c1_lenient_timestamp",
    f"SELECT o_orderkey, try_strptime({DATE_TEXT.format(DUCK_DAY)}, '%Y-%m-%d') AS ts FROM orders",
)
def _(t):
    text = t.orders.selectExpr("o_orderkey", f"{DATE_TEXT.format(SPARK_DAY)} AS d")
    return text.select("o_orderkey", C.lenient_timestamp("d").alias("ts"))


@query(
    "c2_date_plus_clock",
    f"SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%Y-%m-%d') || ' ' || ({CLOCK_TEXT.format(DUCK_CLOCK)}), '%Y-%m-%d %H:%M:%S') AS ts FROM orders",
)
def _(t):
    df = t.orders.selectExpr("o_orderkey", "o_orderdate", f"{CLOCK_TEXT.format(SPARK_CLOCK)} AS clock")
    return df.select("o_orderkey", C.combine_date_time("o_orderdate", "clock").alias("ts"))


@query("c3_floor_to_minute", "SELECT event_id, date_trunc('minute', ts) AS ts FROM events")
def _(t):
    return t.events.select("event_id", C.floor_minute("ts").alias("ts"))


@query(
    "c4_day_of_year_timestamp",
    """SELECT o_orderkey, make_timestamp(CAST(year(o_orderdate) AS BIGINT), 1, 1, 0, 0, 0.0)
       + to_days(CAST(1 + o_orderkey % 365 - 1 AS INTEGER)) + to_hours(CAST(o_custkey % 24 AS INTEGER))
       + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS ts FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        C.day_of_year_timestamp(
            F.year("o_orderdate"), 1 + F.col("o_orderkey") % 365, F.col("o_custkey") % 24, F.col("o_orderkey") % 60
        ).alias("ts"),
    )


@query(
    "c5_round_hour_half_even",
    f"""SELECT event_id, {half_even_hour('ts')} AS exact_ts,
        {half_even_hour("(date_trunc('hour', ts) + INTERVAL '30' MINUTE)")} AS tie_ts FROM events""",
)
def _(t):
    half = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(30))
    return t.events.select("event_id", C.round_hour("ts").alias("exact_ts"), C.round_hour(half).alias("tie_ts"))


@query("c6_hour_and_year", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(year(ts) AS INTEGER) AS y FROM events")
def _(t):
    return t.events.select("event_id", C.hour("ts").alias("h"), C.year("ts").alias("y"))


@query(
    "c7_format_timestamp",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def _(t):
    return t.events.select("event_id", C.iso_text("ts").alias("iso"), C.day_text("ts").alias("day"))


@query(
    "c8_time_grid",
    """SELECT unnest(generate_series(TIMESTAMP '1970-01-01' + to_minutes(CAST(floor(epoch_us(min(ts)) / 600000000.0) * 10 AS INTEGER)),
       TIMESTAMP '1970-01-01' + to_minutes(CAST(floor(epoch_us(max(ts)) / 600000000.0) * 10 AS INTEGER)), INTERVAL 10 MINUTE)) AS ts FROM events""",
)
def _(t):
    return C.span_grid(t.events, "ts", 10)


@query(
    "c9_numeric_grid",
    "SELECT p_partkey, CAST(unnest(range(1000, 1001 + 10 * p_size, 10)) AS DOUBLE) AS altitude FROM part",
)
def _(t):
    h = F.sequence(F.lit(1000), F.lit(1000) + 10 * F.col("p_size"), F.lit(10))
    return t.part.select("p_partkey", F.explode(h.cast("array<double>")).alias("altitude"))


@query("c10_subtract_lag", "SELECT event_id, ts - to_minutes(CAST(30 * (event_id % 145) AS INTEGER)) AS ts FROM events")
def _(t):
    return t.events.select("event_id", C.minus_minutes("ts", 30 * (F.col("event_id") % 145)).alias("ts"))


@query(
    "c11_lag_group_name",
    "SELECT o_orderkey, regexp_replace(n, '_[0-9]+$', '') AS grp FROM (SELECT o_orderkey,"
    " CASE WHEN o_orderstatus = 'P' THEN 'Kp_index' ELSE 'AL_index_' || CAST(o_orderkey % 31 AS VARCHAR) END AS n FROM orders)",
)
def _(t):
    lagged = F.concat(F.lit("AL_index_"), (F.col("o_orderkey") % 31).cast("string"))
    name = F.when(F.col("o_orderstatus") == "P", "Kp_index").otherwise(lagged)
    return t.orders.select("o_orderkey", M.group_of(name).alias("grp"))


@query(
    "c12_tokens_and_labels",
    """SELECT p_partkey, list_extract(regexp_split_to_array(trim('  ' || p_name || '   x '), '\\s+'), 2) AS second_token,
       CAST((p_size // 10) * 1000 AS VARCHAR) || '-' || CAST((p_size // 10) * 1000 + 999 AS VARCHAR) AS label FROM part""",
)
def _(t):
    from lagfield.operators.profiles import bucket_label

    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit("   x "))
    low = (F.floor(F.col("p_size") / 10) * 1000).cast("bigint")
    return t.part.select(
        "p_partkey",
        F.get(F.split(F.trim(padded), r"\s+"), F.lit(1)).alias("second_token"),
        bucket_label(low, 1000).alias("label"),
    )


# -- feature scaling ---------------------------------------------------------

scalar("m1_altitude_scale", {"y": "(Altitude - 4000) / 4000"}, {"y": lambda: M.altitude_scale("Altitude")})
scalar(
    "m2_latitude_scale",
    {c: f"{c} / 90" for c in ("GCLAT", "ILAT", "GLAT", "XXLAT")},
    {c: (lambda c=c: M.latitude_scale(c)) for c in ("GCLAT", "ILAT", "GLAT", "XXLAT")},
)
scalar(
    "m3_longitude_wave",
    {c: f"sin(radians({c}))" for c in ("GCLON", "XXLON")},
    {c: (lambda c=c: M.longitude_wave(c)) for c in ("GCLON", "XXLON")},
)
scalar("m4_local_time_wave", {"y": "sin(GMLT * pi() / 12)"}, {"y": lambda: M.local_time_wave("GMLT")})
scalar("m5_kp_scale", {"y": "Kp_index / 45 - 1"}, {"y": lambda: M.kp_scale("Kp_index")})

SCALE_SQL = {
    "Altitude": "(Altitude - 4000) / 4000",
    "GCLAT": "GCLAT / 90",
    "GCLON": "sin(radians(GCLON))",
    "ILAT": "ILAT / 90",
    "GLAT": "GLAT / 90",
    "GMLT": "sin(GMLT * pi() / 12)",
    "XXLAT": "XXLAT / 90",
    "XXLON": "sin(radians(XXLON))",
    "Kp_index": "Kp_index / 45 - 1",
}


@query(
    "m6_scaling_map",
    with_obs(f"SELECT {BASE}, Te1, " + ", ".join(f"{clean_number(e)} AS {c}" for c, e in SCALE_SQL.items()) + " FROM obs"),
)
def _(t):
    df = M.with_scaling(t.obs.select(*KEYS, "Te1", *SCALE_SQL))
    return df.withColumns({c: real(F.col(c)) for c in SCALE_SQL})


@query(
    "m7_group_z_score",
    with_obs(
        f", s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM (SELECT qty AS v FROM obs UNION ALL SELECT tax FROM obs UNION ALL SELECT discount FROM obs))"
        f" SELECT {BASE}, {rnd('(qty - m) / d')} AS z0, {rnd('(tax - m) / d')} AS z1, {rnd('(discount - m) / d')} AS z2 FROM obs, s"
    ),
)
def _(t):
    from lagfield.operators.statistics import pooled_stats

    df = t.obs.select(*KEYS, F.array("qty", "tax", "discount").alias("g"))
    stats = pooled_stats(df, {"g": ["g"]})
    scaled = df.crossJoin(F.broadcast(stats)).withColumn(
        "g", F.transform("g", lambda x: M.z_score(x, F.col("mean"), F.col("std")))
    )
    return scaled.select(*KEYS, *[real(F.get("g", F.lit(i))).alias(f"z{i}") for i in range(3)])


@query(
    "m8_column_z_score",
    with_obs(
        ", s AS (SELECT avg(Te1) AS m, stddev_samp(Te1) AS d, avg(qty) AS mq, stddev_samp(qty) AS dq FROM obs)"
        f" SELECT {BASE}, {rnd('(Te1 - m) / d')} AS z_te, {rnd('(qty - mq) / dq')} AS z_qty, line - 0.0 AS unscaled FROM obs, s"
    ),
)
def _(t):
    from lagfield.operators.statistics import column_stats
    from lagfield.sources.writers import stats_as_maps

    df = t.obs
    mean, std = stats_as_maps(column_stats(df, ["Te1", "qty"]))
    return df.select(
        *KEYS,
        real(M.z_score("Te1", mean["Te1"], std["Te1"])).alias("z_te"),
        real(M.z_score("qty", mean["qty"], std["qty"])).alias("z_qty"),
        M.z_score(F.col("line").cast("double"), 3.0, 0.0).alias("unscaled"),
    )


@query(
    "m9_log_target_normalise",
    with_obs(
        ", s AS (SELECT avg(Altitude) AS m, stddev_samp(Altitude) AS d FROM obs)"
        f" SELECT {BASE}, {rnd('ln(Te1)')} AS Te1, {rnd('(Altitude - m) / d')} AS Altitude FROM obs, s"
    ),
)
def _(t):
    from lagfield.operators.statistics import column_stats
    from lagfield.plans.scoring import normalize_by_column
    from lagfield.sources.writers import stats_as_maps

    df = t.obs.select(*KEYS, "Te1", "Altitude")
    mean, std = stats_as_maps(column_stats(df, ["Altitude"]))
    out = normalize_by_column(df, mean, std, ["Altitude"], "Te1")
    return out.withColumns({"Te1": real(F.col("Te1")), "Altitude": real(F.col("Altitude"))})


scalar(
    "m10_unscale_outputs",
    {"mean": "qty * 160.25 + -127.5", "variance": "tax * (160.25 * 160.25)"},
    {"mean": lambda: M.unscale_mean("qty", -127.5, 160.25), "variance": lambda: M.unscale_variance("tax", 160.25)},
    digits=4,
)
scalar(
    "m11_target_class",
    {"k": "CAST(greatest(0, least(149, floor((Te1 - 500) * 2 / 100))) AS INTEGER)"},
    {"k": lambda: M.target_class((F.col("Te1") - 500) * 2)},
    numeric=False,
)
scalar(
    "m12_class_centre",
    {"te": "CAST(line * 100 + 50 AS INTEGER)"},
    {"te": lambda: M.class_centre("line").cast("int")},
    numeric=False,
)
scalar(
    "m16_nearest_centre",
    {
        "c": "CASE WHEN ILAT >= 0 AND ILAT < 90 THEN CASE WHEN ILAT <= 25 THEN 20.0 WHEN ILAT <= 35 THEN 30.0"
        " WHEN ILAT <= 45 THEN 40.0 ELSE 50.0 END END"
    },
    {"c": lambda: M.nearest_centre("ILAT", (20, 30, 40, 50))},
)
scalar(
    "m17_residual_deviation",
    {"residual": "Te1 - pred", "deviation": "pred - Te1"},
    {"residual": lambda: M.residual("Te1", "pred"), "deviation": lambda: M.deviation("pred", "Te1")},
    digits=4,
)
scalar("m18_kp_display", {"kp": "Kp_index / 10"}, {"kp": lambda: M.kp_display("Kp_index")})

# -- class scores: the embedding vector stands in for logits ------------------

LOGITS = (
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),"
    " s AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM e),"
    " p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM s) "
)


def _logits(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("z"))


@query("m13_softmax", LOGITS + f"SELECT vec_id, CAST(i AS INTEGER) AS k, {rnd('p', 8)} AS p FROM p")
def _(t):
    p = _logits(t).select("vec_id", F.posexplode(M.softmax("z")).alias("k", "p"))
    return p.withColumn("p", F.round("p", 8))


@query("m14_entropy", LOGITS + f"SELECT vec_id, {rnd('-sum(p * ln(p + 1e-10))')} AS entropy FROM p GROUP BY 1")
def _(t):
    return _logits(t).select("vec_id", F.round(M.entropy(M.softmax("z")), 6).alias("entropy"))


@query("m15_confidence", LOGITS + f"SELECT vec_id, {rnd('100 * max(p)')} AS confidence FROM p GROUP BY 1")
def _(t):
    return _logits(t).select("vec_id", F.round(M.confidence(M.softmax("z")), 6).alias("confidence"))


@query(
    "o3_best_class",
    LOGITS + f"SELECT vec_id, CAST(min(CASE WHEN x = m THEN i END) AS INTEGER) AS k, {rnd('max(p)', 8)} AS top FROM"
    " (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY 1",
)
def _(t):
    return _logits(t).select("vec_id", M.best_class("z").alias("k"), F.round(F.array_max(M.softmax("z")), 8).alias("top"))


# -- geometry ------------------------------------------------------------------

L_SQL = "CASE WHEN pow(cos(radians(ILAT)), 2) >= 1e-9 AND abs(ILAT) < 90 THEN 1 / pow(cos(radians(ILAT)), 2) END"

scalar("g1_l_shell", {"L": L_SQL}, {"L": lambda: G.l_shell("ILAT")}, digits=5)
scalar(
    "g2_ilat_of_l",
    {"ilat": "degrees(acos(1 / sqrt(1 + Kp_index / 10)))"},
    {"ilat": lambda: G.ilat_of_l(1 + F.col("Kp_index") / 10)},
)
scalar(
    "g3_line_top_height",
    {"heq": "(1 + Kp_index / 10 - 1) * 6371"},
    {"heq": lambda: G.line_top_height(1 + F.col("Kp_index") / 10)},
    digits=4,
)
scalar("g4_radius_ratio", {"r": "1 + Altitude / 6371"}, {"r": lambda: G.radius_ratio("Altitude")})
FOOT_X = "(6670 * pow(cos(radians(GLAT)), 2) / (6370 + Altitude))"
scalar(
    "g5_foot_sine_squared",
    {"s": f"CASE WHEN {FOOT_X} <= 1 THEN pow(sin(acos(sqrt(least({FOOT_X}, 1)))), 2) END"},
    {"s": lambda: G.foot_sine_squared("GLAT", "Altitude")},
)
scalar("g6_latitude_sine_squared", {"s": "pow(sin(radians(GLAT)), 2)"}, {"s": lambda: G.latitude_sine_squared("GLAT")})
scalar(
    "g7_grid_latitude",
    {"glat": "90 - degrees(asin(greatest(-1, least(1, sqrt((Altitude + 6378) / (2 * 6378))))))"},
    {"glat": lambda: G.grid_latitude("Altitude")},
)
LAM = "acos(sqrt(greatest(0, least(1, (Altitude + 6371) / 6371 / 3))))"
R_RE = "((Altitude + 6371) / 6371)"
scalar(
    "g8_dipole_position",
    {
        "r_re": R_RE,
        "mag_lat_rad": LAM,
        "x_sm": f"{R_RE} * cos({LAM}) * cos(radians(XXLON))",
        "y_sm": f"{R_RE} * cos({LAM}) * sin(radians(XXLON))",
        "z_sm": f"{R_RE} * sin({LAM})",
    },
    {
        n: (lambda n=n: G.dipole_position("Altitude", F.lit(3.0), "XXLON")[n])
        for n in ("r_re", "mag_lat_rad", "x_sm", "y_sm", "z_sm")
    },
)
MLT = "((GCLON - 270) / 15 + 12)"
scalar(
    "g9_magnetic_local_time",
    {"mlt": f"{MLT} - 24 * floor({MLT} / 24)"},
    {"mlt": lambda: G.magnetic_local_time(F.col("GCLON") - 270)},
)

# -- physics -------------------------------------------------------------------


def poly(s: str, a) -> str:
    a0, a1, a2, a3, a4 = (f"{x:.17g}e0" for x in a)
    return f"(({a0} + {a1} * {s} + {a2} * {s} * {s}) / nullif(1 + {a3} * {s} + {a4} * {s} * {s}, 0))"


def gradient_sql(h: str, shell: str) -> str:
    ell = f"(CASE WHEN {h} > 0 THEN log10({h} / 400) END)"
    return f"(0.05e0 / nullif(2 * {shell} - (1 + 400 / 6371e0), 0) * (88 + {ell} * (10.5e0 - {ell})))"


def temperature_sql(h: str, t0: str, g0: str, shell: str) -> str:
    """Te(h), null where the bracket is negative."""
    r0, rh, top = "(1 + 400 / 6371e0)", f"(1 + {h} / 6371)", f"(({shell} - 1) * 6371)"
    inner = (
        f"(1 + {gradient_sql(h, shell)} * ({g0} / nullif({t0}, 0))"
        f" * (({top} - 400) / ({r0} * {r0}) - ({top} - {h}) / ({rh} * {rh})))"
    )
    return f"(CASE WHEN {inner} >= 0 THEN {t0} * pow({inner}, 2 / 7e0) END)"


SINE = "pow(sin(radians(GLAT)), 2)"
scalar(
    "h1_rational_polynomial",
    {
        f"{p}_{w}".lower(): poly(SINE, H.COEFFICIENTS[p][w]) for p in ("Day", "Night") for w in ("T0", "G0")
    },
    {
        f"{p}_{w}".lower(): (lambda p=p, w=w: H.rational(G.latitude_sine_squared("GLAT"), H.COEFFICIENTS[p][w]))
        for p in ("Day", "Night")
        for w in ("T0", "G0")
    },
    digits=5,
)
scalar(
    "h2_gradient_factor",
    {"b": gradient_sql("Altitude", "(1 + Kp_index / 10)")},
    {"b": lambda: H.gradient_factor("Altitude", 1 + F.col("Kp_index") / 10)},
)
scalar(
    "h3_temperature",
    {"te": temperature_sql("Altitude", "Te1", "(qty / 10)", "(1 + Kp_index / 10)")},
    {"te": lambda: H.temperature("Altitude", "Te1", F.col("qty") / 10, 1 + F.col("Kp_index") / 10)},
    digits=4,
)
