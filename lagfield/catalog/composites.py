"""User-level jobs: cleaning, feature tables, baselines, grids, evaluation, reports."""

from pyspark.sql import functions as F

from lagfield.catalog.aggregates import (
    BUCKET,
    CENTRE,
    PART,
    PERCENT_SQL,
    R2_SQL,
    WITHIN_SQL,
    box_sql,
    round_box,
)
from lagfield.catalog.base import FLUX_SQL, INVALID_SQL, KP_SQL, MINUTE_SQL, PURCHASE_SQL, bin_of, clean_number, query, rnd, with_obs
from lagfield.catalog.joins import HOURS_SQL, NEAREST, gather_sql
from lagfield.catalog.scalars import FOOT_X, L_SQL, SCALE_SQL, SINE, poly, real, temperature_sql
from lagfield.functions.thermal import COEFFICIENTS
from lagfield.operators.statistics import accuracy_report
from lagfield.plans import baselines, dataset, evaluation, reports, synthetic
from lagfield.plans.scoring import preprocess
from lagfield.schema import LAG_GROUPS, POSITION, feature_columns, lag_columns

# -- cleaning ---------------------------------------------------------------------


@query(
    "k1_clean_observations",
    with_obs(
        "SELECT okey, line, pkey, Altitude, ILAT, XXLAT, CASE WHEN line <> 5 THEN ts END AS DateTimeFormatted FROM"
        " (SELECT *, part AS pkey FROM obs) WHERE NOT (coalesce(XXLAT = 999, false) OR coalesce(XXLON = 999, false))"
        " AND ILAT <= 90 AND Altitude BETWEEN 1000 AND 8000 AND date_trunc('day', ts) >= TIMESTAMP '1996-01-01'"
    ),
)
def _(t):
    raw = t.obs.withColumns(
        {
            "DateFormatted": F.to_date("ts").cast("timestamp_ntz"),
            "TimeFormatted": F.when(F.col("line") == 5, "??").otherwise(F.date_format("ts", "HH:mm:ss")),
            "Date": F.lit("x"),
            "Time": F.lit("y"),
        }
    ).withColumnRenamed("part", "pkey")
    df = dataset.clean(raw, "1996-01-01")
    return df.select("okey", "line", "pkey", "Altitude", "ILAT", "XXLAT", "DateTimeFormatted")


# -- features ----------------------------------------------------------------------


def series_of(t) -> dataset.IndexSeries:
    return dataset.IndexSeries(t.minute_series, t.flux_series, t.kp_series)


def pivot_sql(key: str, long: str, group: str) -> str:
    cols = ", ".join(
        f"max(CASE WHEN lag = {i} THEN value END) AS {c}" for i, c in enumerate(lag_columns(group))
    )
    return f"SELECT {key}, {cols} FROM ({long}) GROUP BY 1"


def feature_ctes() -> str:
    groups = {"AL_index": "minute_series", "SYM_H": "minute_series", "f107_index": "flux"}
    parts = [f"obs AS ({PURCHASE_SQL})", f"minute_series AS ({MINUTE_SQL})", f"flux AS ({FLUX_SQL})", f"kp AS ({KP_SQL})"]
    for g, s in groups.items():
        parts.append(f"w_{g} AS ({pivot_sql('event_id', gather_sql(g, g, s, LAG_GROUPS[g]), g)})")
    from lagfield.catalog.base import half_even_hour

    parts.append(
        "w AS (SELECT 'e' || CAST(o.event_id AS VARCHAR) AS id, o.t AS DateTimeFormatted, o.* EXCLUDE (event_id, t),"
        " a.* EXCLUDE (event_id), b.* EXCLUDE (event_id), c.* EXCLUDE (event_id), kp.Kp_index FROM obs o"
        " JOIN w_AL_index a USING (event_id) JOIN w_SYM_H b USING (event_id) JOIN w_f107_index c USING (event_id)"
        f" LEFT JOIN kp ON kp.ts = {half_even_hour('o.t')})"
    )
    return "WITH " + ", ".join(parts) + " "


ZEROED = ", ".join(f"CASE WHEN {c} IN {INVALID_SQL} THEN 0 ELSE {c} END AS {c}" for c in [*feature_columns(), "Te1"])


def keyed_purchases(t):
    df = t.purchases.withColumnRenamed("t", "DateTimeFormatted")
    return df.withColumn("id", F.concat(F.lit("e"), F.col("event_id").cast("string"))).drop("event_id")


@query("k2_feature_table", feature_ctes() + f"SELECT id, DateTimeFormatted, {ZEROED} FROM w")
def _(t):
    return dataset.feature_table(keyed_purchases(t), series_of(t))


MEANS = {"AL_index": -127.5, "SYM_H": -13.9, "f107_index": 129.0}
STDS = {"AL_index": 160.2, "SYM_H": 22.1, "f107_index": 53.7}


def preprocess_sql() -> str:
    cols = []
    for c in feature_columns():
        if c in SCALE_SQL:
            e = SCALE_SQL[c]
        else:
            g = c.rpartition("_")[0]
            e = f"({c} - {MEANS[g]}e0) / {STDS[g]}e0"
        cols.append(f"coalesce({rnd(e)}, 0) AS {c}")
    return ", ".join(cols)


@query("k9_preprocess_for_scoring", feature_ctes() + f"SELECT id, {preprocess_sql()} FROM w")
def _(t):
    wide = dataset.wide(dataset.add_index_features(keyed_purchases(t), series_of(t)))
    out = preprocess(wide, MEANS, STDS, feature_columns())
    return out.selectExpr("id", *[f"round({c}, 6) AS {c}" for c in feature_columns()])


# -- baselines ----------------------------------------------------------------------


def base_sql(s: str, which: str) -> str:
    return (
        f"CASE day_part WHEN 'Day' THEN {poly(s, COEFFICIENTS['Day'][which])}"
        f" WHEN 'Night' THEN {poly(s, COEFFICIENTS['Night'][which])} END"
    )


MODEL_CTES = (
    f", m1 AS (SELECT *, {PART} AS day_part, CASE WHEN {FOOT_X} <= 1 THEN pow(sin(acos(sqrt(least({FOOT_X}, 1)))), 2) END AS s_L, {L_SQL} AS L FROM obs),"
    f" m2 AS (SELECT *, {base_sql('s_L', 'T0')} AS T_0, {base_sql('s_L', 'G0')} AS G_0 FROM m1 WHERE day_part IS NOT NULL),"
    f" m3 AS (SELECT *, {temperature_sql('Altitude', 'T_0', 'G_0', 'L')} AS Te_model FROM m2)"
)


@query(
    "k4_polynomial_baseline",
    with_obs(
        MODEL_CTES
        + f" SELECT okey, line, pkey, day_part, {clean_number('s_L')} AS s_L, {clean_number('T_0', 4)} AS T_0,"
        f" {clean_number('G_0', 5)} AS G_0, {clean_number('Te_model', 4)} AS Te_model FROM (SELECT *, part AS pkey FROM m3)"
    ),
)
def _(t):
    df = baselines.polynomial_model(t.obs.withColumnRenamed("part", "pkey"), "ts")
    cols = [real(F.col(c), d).alias(c) for c, d in (("s_L", 6), ("T_0", 4), ("G_0", 5), ("Te_model", 4))]
    return df.select("okey", "line", "pkey", "day_part", *cols)


def report_sql(p: str) -> str:
    every = {
        "r2": rnd(R2_SQL.replace("pred", p), 5),
        "rmse": rnd(f"sqrt(avg(pow(Te1 - {p}, 2)))", 4),
        "mean_deviation": rnd(f"avg({p} - Te1)", 4),
        **{n: rnd(e.replace("pred", p)) for n, e in {**WITHIN_SQL, **PERCENT_SQL}.items()},
    }
    return "count(*) AS n, " + ", ".join(f"{e} AS {n}" for n, e in every.items())


def rounded_report(df):
    digits = {"r2": 5, "rmse": 4, "mean_deviation": 4}
    return df.withColumns({c: F.round(c, digits.get(c, 6)) for c, k in df.dtypes if k == "double"})


@query(
    "k4_polynomial_baseline_accuracy",
    with_obs(
        MODEL_CTES + f" SELECT day_part, {report_sql('Te_model')} FROM m3 WHERE isfinite(Te_model) GROUP BY 1"
    ),
)
def _(t):
    df = baselines.polynomial_model(t.obs, "ts")
    return rounded_report(accuracy_report(df, "Te1", "Te_model", ["day_part"]))


PROFILE = "700 + p_retailprice + p_size * 3 * {k} + (p_partkey % 7) * {k} * {k} / 2e0"


@query(
    "k5_gradient_fit",
    f"""WITH p AS (SELECT p_partkey, CAST(15 + p_partkey % 55 AS DOUBLE) AS ILAT, CAST(1000 + (p_partkey * 37) % 7001 AS DOUBLE) AS Altitude,
        k, {PROFILE.format(k='k')} AS y, {PROFILE.format(k='0')} AS T_ref FROM part CROSS JOIN (SELECT unnest(range(17)) AS k)),
        c AS (SELECT *, {temperature_sql('h', '1e0', '1e0', 'L')} AS one FROM (SELECT *, 400e0 + 100 * k AS h, {L_SQL} AS L FROM p)),
        x AS (SELECT *, pow(one, 3.5e0) - 1 AS term FROM c),
        g AS (SELECT i, -20e0 + i * ((50e0 + 20) / 700) AS g FROM (SELECT unnest(range(701)) AS i)),
        e AS (SELECT p_partkey, i, any_value(g) AS g, any_value(T_ref) AS T_ref, any_value(L) AS L, any_value(Altitude) AS Altitude,
              bool_and(1 + g / T_ref * term >= 0) AS fit, sum(pow(y - T_ref * pow(greatest(1 + g / T_ref * term, 0), 2 / 7e0), 2)) AS sse FROM x, g GROUP BY 1, 2),
        b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sse, i) AS r FROM e WHERE fit)
        SELECT p_partkey, T_ref, round(g, 1) AS best_G0, {rnd(temperature_sql('Altitude', 'T_ref', 'round(g, 1)', 'L'), 3)} AS Te_model FROM b WHERE r = 1""",
)
def _(t):
    df = t.part.selectExpr(
        "p_partkey",
        "CAST(15 + p_partkey % 55 AS DOUBLE) AS ILAT",
        "CAST(1000 + (p_partkey * 37) % 7001 AS DOUBLE) AS Altitude",
        "array(" + ", ".join(PROFILE.format(k=k) for k in range(17)) + ") AS profile",
    )
    out = baselines.fitted_model(df)
    return out.select("p_partkey", "T_ref", "best_G0", real(F.col("Te_model"), 3).alias("Te_model"))


CURVE_COLUMNS = {"v1_day": ("t1", "g1", "Day"), "v1_night": ("t1", "g1", "Night"), "v2_day": ("t2", "g2", "Day"), "v2_night": ("t2", "g2", "Night")}
CENTRE_L = "(1 / pow(cos(radians(centre)), 2))"


def curves_sql() -> str:
    means = ", ".join(
        f"avg({v}) FILTER (day_part = '{p}') AS {n}_{p}"
        for n, v in (("t1", "v_t"), ("g1", "v_g"), ("t2", "T_ref"), ("g2", "best_G0"))
        for p in ("Day", "Night")
    )
    te = ", ".join(
        f"{rnd(temperature_sql('h', f'{a}_{p}', f'{b}_{p}', CENTRE_L), 4)} AS {n}" for n, (a, b, p) in CURVE_COLUMNS.items()
    )
    return with_obs(
        f", c AS (SELECT *, {CENTRE} AS centre, {PART} AS day_part, {SINE} AS s, Te1 AS T_ref, qty / 10 AS best_G0 FROM obs WHERE ILAT BETWEEN 15 AND 55),"
        f" v AS (SELECT *, {base_sql('s', 'T0')} AS v_t, {base_sql('s', 'G0')} AS v_g FROM c WHERE day_part IS NOT NULL),"
        f" m AS (SELECT centre, {means} FROM v GROUP BY 1)"
        f" SELECT centre, h, {te} FROM m CROSS JOIN (SELECT CAST(unnest(range(0, 5101, 25)) AS DOUBLE) AS h)"
    )


@query("k6_centre_curves", curves_sql())
def _(t):
    df = t.obs.withColumns({"T_ref": F.col("Te1"), "best_G0": F.col("qty") / 10})
    out = baselines.centre_curves(df, "ts")
    return out.select("centre", "h", *[real(F.col(c), 4).alias(c) for c in CURVE_COLUMNS])


SWEEP = {"t0": "2500 + s_acctbal / 10", "g0": "CAST(s_nationkey AS DOUBLE) / 5", "ilat": "CAST(20 + s_nationkey * 2 AS DOUBLE)"}
SWEEP_SQL = ", ".join(f"{e} AS {n}" for n, e in SWEEP.items())


@query(
    "k7_height_sweep",
    f"WITH p AS (SELECT s_suppkey, {SWEEP_SQL} FROM supplier)"
    f" SELECT s_suppkey, h, {rnd(temperature_sql('h', 't0', 'g0', '(1 / pow(cos(radians(ilat)), 2))'), 4)} AS te"
    " FROM p CROSS JOIN (SELECT CAST(unnest(range(1000, 15000, 100)) AS DOUBLE) AS h)",
)
def _(t):
    params = t.supplier.selectExpr("s_suppkey", *[f"{e} AS {n}" for n, e in SWEEP.items()])
    return baselines.height_sweep(params).select("s_suppkey", "h", real(F.col("te"), 4).alias("te"))


@query(
    "k7_polynomial_sweep",
    "SELECT p_partkey, "
    + ", ".join(f"{rnd(poly('(p_size / 50e0)', COEFFICIENTS[p][w]), 5)} AS {p}_{w}" for p in ("Day", "Night") for w in ("T0", "G0"))
    + " FROM part",
)
def _(t):
    df = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("s"))
    out = df.select("p_partkey", *baselines.sweep_columns("s"))
    return out.select("p_partkey", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


# -- synthetic grids -------------------------------------------------------------------


def hours(t):
    return t.events.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("h")).distinct()


def nearest_cte(name: str, series: str, column: str, count: int, step: int) -> str:
    """Nearest-key lags of the hours, long form."""
    rows = f"(SELECT h, CAST(k AS INTEGER) AS lag, h - to_hours(CAST(k * {step} AS INTEGER)) AS t FROM times CROSS JOIN (SELECT unnest(range({count})) AS k))"
    series_sql = f"(SELECT ts, {column} AS v FROM {series})"
    return f"{name} AS ({NEAREST.format(keys='o.h AS event_id, o.lag', rows=rows, series=series_sql)})"


def masked(c: str) -> str:
    return f"CASE WHEN {c} NOT IN (999.9, 99999.99) THEN {c} END AS {c}"


def grid_ctes(minute: str, flux: str, kp: str) -> str:
    parts = [
        f"times AS ({HOURS_SQL})",
        "obs AS (SELECT h AS event_id, h AS t FROM times)",
        f"minute_series AS ({minute})",
        f"flux AS ({flux})",
        f"kp AS ({kp})",
        nearest_cte("nf", "flux", "f107_index", 4, 24),
        nearest_cte("nk", "kp", "Kp_index", 1, 1),
    ]
    for g in ("AL_index", "SYM_H"):
        parts.append(f"w_{g} AS ({pivot_sql('event_id', gather_sql(g, g, 'minute_series', LAG_GROUPS[g]), g)})")
    parts.append(f"w_f AS ({pivot_sql('event_id', 'SELECT event_id, lag, value FROM nf', 'f107_index')})")
    parts.append(
        "w AS (SELECT a.event_id AS DateTimeFormatted, a.* EXCLUDE (event_id), b.* EXCLUDE (event_id), c.* EXCLUDE (event_id), nk.value AS Kp_index"
        " FROM w_AL_index a JOIN w_SYM_H b USING (event_id) JOIN w_f c USING (event_id) JOIN nk USING (event_id))"
    )
    return "WITH " + ", ".join(parts) + " "


INDEX_COLUMNS = [c for c in feature_columns() if c not in POSITION]
GRID_ALTITUDES = "(SELECT CAST(unnest(range(1000, 8001, 10)) AS DOUBLE) AS Altitude)"


def by_time_sql(grid: str, altitude_columns: list[str]) -> str:
    """A grid told by one row a time: how many altitudes, sums of what depends on them, both ends of the rest."""
    sums = [f"{rnd(f'sum({c})', 3)} AS sum_{c}" for c in altitude_columns]
    ends = [f"min({c}) AS {c}" for c in INDEX_COLUMNS] + [f"max({c}) AS max_{c}" for c in ENDS]
    return f"SELECT DateTimeFormatted, count(*) AS n, {', '.join(sums + ends)} FROM ({grid}) GROUP BY 1"


def by_time(grid, altitude_columns):
    sums = [(F.round(F.sum(c), 3) + 0.0).alias(f"sum_{c}") for c in altitude_columns]
    ends = [F.min(c).alias(c) for c in INDEX_COLUMNS] + [F.max(c).alias(f"max_{c}") for c in ENDS]
    return grid.groupBy("DateTimeFormatted").agg(F.count("*").alias("n"), *sums, *ends)


ENDS = ["AL_index_0", "SYM_H_144", "f107_index_3", "Kp_index"]


PLAIN_SUMS = ["Altitude", "GCLAT", "GCLON", "ILAT", "GMLT", "XXLAT", "XXLON", "GLAT"]


@query(
    "k8_plain_grid",
    grid_ctes(MINUTE_SQL, FLUX_SQL, KP_SQL)
    + by_time_sql(
        "SELECT DateTimeFormatted, Altitude, 0e0 AS GCLAT, 0e0 AS GCLON, 45e0 AS ILAT, 0e0 AS GMLT, 0e0 AS XXLAT, 0e0 AS XXLON,"
        " 90 - degrees(asin(greatest(-1, least(1, sqrt((Altitude + 6378) / (2 * 6378)))))) AS GLAT, "
        + ", ".join(masked(c) for c in INDEX_COLUMNS)
        + f" FROM w CROSS JOIN {GRID_ALTITUDES}",
        PLAIN_SUMS,
    ),
)
def _(t):
    return by_time(synthetic.plain_grid(hours(t), "h", series_of(t)), PLAIN_SUMS)


# Daily extremes carried by every minute of the day: a series without gaps.
DAY_SQL = "SELECT date_trunc('day', ts) AS d, 0 - max(value) AS AL_index, min(value) - 20 AS SYM_H, avg(value) AS f107_index FROM events GROUP BY 1"
DENSE_SQL = f"SELECT d + to_minutes(CAST(m AS INTEGER)) AS ts, AL_index, SYM_H FROM ({DAY_SQL}) CROSS JOIN (SELECT unnest(range(1440)) AS m)"
DAY_FLUX_SQL = f"SELECT d AS ts, round(f107_index, 4) AS f107_index FROM ({DAY_SQL})"
SM_LON = "((hour({h}) * 15 + day({h}) * 7) % 360 - 180.5e0)"


ANCHORED_SUMS = ["Altitude", "GMLT", "ILAT", "GLAT", "x_sm", "y_sm", "z_sm"]


@query(
    "k8_anchored_grid",
    grid_ctes(DENSE_SQL, DAY_FLUX_SQL, KP_SQL)
    + f", g AS (SELECT *, {SM_LON.format(h='DateTimeFormatted')} AS lon, (Altitude + 6371) / 6371 AS r FROM w CROSS JOIN {GRID_ALTITUDES}),"
    " q AS (SELECT *, acos(sqrt(greatest(0, least(1, r / 3)))) AS lam, lon / 15 + 12 AS mlt FROM g)"
    + by_time_sql(
        "SELECT DateTimeFormatted, Altitude, mlt - 24 * floor(mlt / 24) AS GMLT, degrees(acos(1 / sqrt(3))) AS ILAT,"
        " degrees(lam) AS GLAT, r * cos(lam) * cos(radians(lon)) AS x_sm, r * cos(lam) * sin(radians(lon)) AS y_sm,"
        f" r * sin(lam) AS z_sm, {', '.join(INDEX_COLUMNS)} FROM q WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in INDEX_COLUMNS),
        ANCHORED_SUMS,
    ),
)
def _(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    days = t.events.groupBy(day.alias("d")).agg(
        (-F.max("value")).alias("AL_index"), (F.min("value") - 20).alias("SYM_H"), F.round(F.avg("value"), 4).alias("f107_index")
    )
    minute = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("m")).select(
        (F.col("d") + F.make_dt_interval(mins=F.col("m"))).alias("ts"), "AL_index", "SYM_H"
    )
    series = dataset.IndexSeries(minute, days.select(F.col("d").alias("ts"), "f107_index"), t.kp_series)
    lon = (F.hour("h") * 15 + F.day("h") * 7) % 360 - F.lit(180.5)
    times = hours(t).withColumn("lon", lon)
    grid = synthetic.anchored_grid(times, "h", "lon", series, threshold_percent=25.0)
    return by_time(grid, ANCHORED_SUMS)


# -- evaluation and reports ---------------------------------------------------------------

SPLIT = "CASE WHEN ts >= TIMESTAMP '1998-01-31' AND ts < TIMESTAMP '1998-03-07' THEN 'test-storm' ELSE 'test-normal' END"


def _splits(t):
    return t.obs.selectExpr("*", f"{SPLIT.replace('TIMESTAMP', 'TIMESTAMP_NTZ')} AS split")


@query("k12_split_accuracy", with_obs(f", v AS (SELECT *, {SPLIT} AS split FROM obs) SELECT split, {report_sql('pred')} FROM v GROUP BY 1"))
def _(t):
    report, _hist = reports.evaluate_splits(_splits(t), "Te1", "pred", "split", "test-normal")
    return rounded_report(report)


@query(
    "k12_split_histogram",
    with_obs(
        f", v AS (SELECT *, {SPLIT} AS split FROM obs WHERE Te1 >= 0 AND pred >= 0),"
        " m AS (SELECT least(min(Te1), min(pred)) AS lo, greatest(max(Te1), max(pred)) AS hi FROM v WHERE split = 'test-normal')"
        f" SELECT * FROM (SELECT split, {bin_of('pred', 'lo', 'hi', 100)} AS pred_bin, {bin_of('Te1', 'lo', 'hi', 100)} AS obs_bin,"
        " count(*) AS n FROM v, m GROUP BY 1, 2, 3) WHERE pred_bin IS NOT NULL AND obs_bin IS NOT NULL"
    ),
)
def _(t):
    _report, hist = reports.evaluate_splits(_splits(t), "Te1", "pred", "split", "test-normal")
    return hist


# -- a network end to end -------------------------------------------------------------------


def patterned_network(inputs: int, hidden: list[int], classes: int) -> list[dict]:
    """Layers with integer-patterned weights, for SQL to state as well."""
    layers, size = [], inputs
    for n, units in enumerate([*hidden, classes]):
        layer = {
            "weight": [[(i * 5 + j * 3 + n) % 7 - 3 for i in range(size)] for j in range(units)],
            "bias": [(j % 4) / 8 - 0.25 for j in range(units)],
        }
        if n < len(hidden):
            layer |= {"gamma": [1 + (j % 3) / 4 for j in range(units)], "beta": [(j % 5 - 2) / 4 for j in range(units)]}
        layers.append(layer)
        size = units
    return layers


def network_ctes(source: str, keep: list[str], inputs: list[str], layers: list[dict], width: int) -> str:
    """CTEs that end in ``net``: keep, predicted, confidence, entropy of every row of ``source``."""
    kept, size = ", ".join(keep), len(inputs)
    parts = [f"l0 AS (SELECT {kept}, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(inputs)) + f" FROM {source})"]

    def unit(layer, j):
        return " + ".join([f"x{i} * ({w})" for i, w in enumerate(layer["weight"][j])] + [f"({layer['bias'][j]!r}::DOUBLE)"])

    for n, layer in enumerate(layers[:-1]):
        size = len(layer["bias"])
        own = ", ".join(f"{unit(layer, j)} AS h{j}" for j in range(size))
        mean = " + ".join(f"h{j}" for j in range(size))
        spread = " + ".join(f"pow(h{j} - mu, 2)" for j in range(size))
        out = ", ".join(
            f"greatest(0, (h{j} - mu) / sqrt(va + 1e-5) * ({layer['gamma'][j]!r}::DOUBLE) + ({layer['beta'][j]!r}::DOUBLE)) AS x{j}"
            for j in range(size)
        )
        parts += [
            f"h{n} AS (SELECT {kept}, {own} FROM l{n})",
            f"m{n} AS (SELECT *, ({mean}) / {size} AS mu FROM h{n})",
            f"v{n} AS (SELECT *, ({spread}) / {size} AS va FROM m{n})",
            f"l{n + 1} AS (SELECT {kept}, {out} FROM v{n})",
        ]
    last, classes = layers[-1], range(len(layers[-1]["bias"]))
    top = ", ".join(f"z{k}" for k in classes)
    best = " ".join(f"WHEN z{k} = top THEN {k}" for k in classes)
    mass = " + ".join(f"exp(z{k} - top)" for k in classes)
    entropy = " + ".join(f"exp(z{k} - top) / mass * ln(exp(z{k} - top) / mass + 1e-10)" for k in classes)
    parts += [
        f"z AS (SELECT {kept}, {', '.join(f'{unit(last, k)} AS z{k}' for k in classes)} FROM l{len(layers) - 1})",
        f"t AS (SELECT *, greatest({top}) AS top FROM z)",
        f"s AS (SELECT *, {mass} AS mass FROM t)",
        f"net AS (SELECT {kept}, (CASE {best} END) * {float(width)!r} + {width // 2} AS predicted, 100 / mass AS confidence,"
        f" -({entropy}) AS entropy FROM s)",
    ]
    return ", ".join(parts)


NET_INPUTS = ["Altitude", "ILAT", "GLAT", "GMLT", "XXLON", "Kp_index"]
NET_WIDTH = 1000
NET = patterned_network(len(NET_INPUTS), [9, 7], 11)
NET_CTES = (
    f", v AS (SELECT *, {SPLIT} AS split FROM obs), "
    + network_ctes("v", ["split", "Te1"], [f"coalesce({SCALE_SQL[c]}, 0)" for c in NET_INPUTS], NET, NET_WIDTH)
    + ", p AS (SELECT split, Te1, predicted AS pred, entropy FROM net)"
)


def _evaluated(t):
    inputs = [NET_INPUTS, {}, {}, NET]
    return evaluation.evaluate_network(
        _splits(t), *inputs, "Te1", "split", "test-normal", width=NET_WIDTH, precision="float64"
    )


@query(
    "k12_network_accuracy",
    with_obs(NET_CTES + f" SELECT split, {report_sql('pred')}, {rnd('avg(entropy)', 5)} AS mean_entropy FROM p GROUP BY 1"),
)
def _(t):
    report = _evaluated(t)[0]
    return rounded_report(report.drop("mean_entropy")).join(report.select("split", F.round("mean_entropy", 5).alias("mean_entropy")), "split")


@query(
    "k12_network_histogram",
    with_obs(
        NET_CTES
        + ", m AS (SELECT least(min(Te1), min(pred)) AS lo, greatest(max(Te1), max(pred)) AS hi FROM p WHERE split = 'test-normal')"
        f" SELECT * FROM (SELECT split, {bin_of('pred', 'lo', 'hi', 100)} AS pred_bin, {bin_of('Te1', 'lo', 'hi', 100)} AS obs_bin,"
        " count(*) AS n FROM p, m GROUP BY 1, 2, 3) WHERE pred_bin IS NOT NULL AND obs_bin IS NOT NULL"
    ),
)
def _(t):
    return _evaluated(t)[1]


GRID_INPUTS = ["Altitude", "GLAT", "Kp_index", "AL_index_0", "f107_index_3"]
GRID_NET = patterned_network(len(GRID_INPUTS), [8], 12)
GRID_ROWS = (
    "SELECT DateTimeFormatted, Altitude, 90 - degrees(asin(greatest(-1, least(1, sqrt((Altitude + 6378) / (2 * 6378)))))) AS GLAT, "
    + ", ".join(masked(c) for c in GRID_INPUTS[2:])
    + f" FROM w CROSS JOIN {GRID_ALTITUDES}"
)


def _grid_input(c: str) -> str:
    group = c.rpartition("_")[0]
    return f"coalesce({SCALE_SQL[c] if c in SCALE_SQL else f'({c} - ({MEANS[group]})) / {STDS[group]}'}, 0)"


@query(
    "k8_scored_grid",
    grid_ctes(MINUTE_SQL, FLUX_SQL, KP_SQL)
    + f", g AS ({GRID_ROWS}), "
    + network_ctes("g", ["DateTimeFormatted", "Altitude"], [_grid_input(c) for c in GRID_INPUTS], GRID_NET, 100)
    + " SELECT DateTimeFormatted, "
    + ", ".join(f'max(CASE WHEN Altitude = {a} THEN predicted END) AS "{float(a)}"' for a in range(1000, 8001, 10))
    + " FROM net GROUP BY 1",
)
def _(t):
    grid = synthetic.plain_grid(hours(t), "h", series_of(t))
    scored = evaluation.scored_grid(grid, GRID_INPUTS, MEANS, STDS, GRID_NET, precision="float64")
    return evaluation.grid_matrix(scored, "predicted", [float(a) for a in range(1000, 8001, 10)])


EXPLORE = ["o_custkey", "o_totalprice"]


@query(
    "k13_exploration_by_year",
    "SELECT b.*, y.rows_in_year FROM ("
    + box_sql("orders", "CAST(year(o_orderdate) AS INTEGER)", EXPLORE, "year")
    + ") b JOIN (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows_in_year FROM orders GROUP BY 1) y USING (year)",
)
def _(t):
    tables = reports.exploration(t.orders, "o_orderdate", "o_totalprice", EXPLORE, BUCKET, ["per_year", "box_by_year"])
    years = tables["per_year"].withColumnRenamed("n", "rows_in_year")
    return round_box(tables["box_by_year"]).join(years, "year")


@query(
    "k13_exploration_by_bucket",
    "SELECT b.*, CAST(bucket AS VARCHAR) || '-' || CAST(bucket + 49999 AS VARCHAR) AS label FROM ("
    + box_sql("orders", f"CAST((ceil(o_totalprice / {BUCKET}) - 1) * {BUCKET} AS BIGINT)", EXPLORE, "bucket")
    + ") b",
)
def _(t):
    tables = reports.exploration(t.orders, "o_orderdate", "o_totalprice", EXPLORE, BUCKET, ["per_bucket", "box_by_bucket"])
    labels = tables["per_bucket"].select("bucket", "label")
    return round_box(tables["box_by_bucket"]).join(labels, "bucket")


@query(
    "k14_track_table",
    with_obs(
        f"SELECT ts, Altitude, ILAT, Te1, pred, {rnd('Te1 - pred', 4)} AS residual FROM obs"
        " WHERE ts >= TIMESTAMP '1997-03-01' AND ts < TIMESTAMP '1997-09-01' ORDER BY ts"
    ),
)
def _(t):
    df = reports.residuals(t.obs, "Te1", "pred")
    out = reports.track(df, "ts", ["Altitude", "ILAT", "Te1", "pred", "residual"], "1997-03-01", "1997-08-31")
    return out.withColumn("residual", F.round("residual", 4))
