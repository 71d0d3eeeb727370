"""Statistics, accuracy measures, histograms, profiles, percentiles, distincts."""

from pyspark.sql import functions as F

from lagfield.catalog.base import bin_of, query, rnd, with_obs
from lagfield.operators import histograms as A
from lagfield.operators import keyed, percentiles, profiles
from lagfield.operators import statistics as S
from lagfield.operators.cleaning import null_counts
from lagfield.plans.reports import HEATMAP_RANGES, observation_heatmaps
from lagfield.schema import ABSOLUTE_THRESHOLDS, DESCRIBE_PERCENTILES, RELATIVE_THRESHOLDS

# -- statistics ----------------------------------------------------------------


@query(
    "a1_pooled_group_statistics",
    with_obs(
        ", c AS (SELECT 'small' AS name, unnest([tax, discount, line / 100e0]) AS v FROM obs"
        " UNION ALL SELECT 'lat', unnest([GLAT, GCLAT]) FROM obs UNION ALL SELECT 'gap', XXLAT FROM obs)"
        f" SELECT name, {rnd('avg(v)')} AS mean, {rnd('stddev_pop(v)')} AS std FROM c WHERE v IS NOT NULL GROUP BY 1"
    ),
)
def _(t):
    df = t.obs.withColumns({"lat": F.array("GLAT", "GCLAT"), "ln": F.col("line") / 100.0})
    stats = S.pooled_stats(df, {"small": ["tax", "discount", "ln"], "lat": ["lat"], "gap": ["XXLAT"]})
    return stats.select("name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


A2_COLUMNS = ["Te1", "Altitude", "GMLT", "XXLAT"]


@query(
    "a2_column_statistics",
    with_obs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, {rnd(f'avg({c})', 5)} AS mean, {rnd(f'stddev_samp({c})', 5)} AS std FROM obs"
            for c in A2_COLUMNS
        )
    ),
)
def _(t):
    stats = S.column_stats(t.obs, A2_COLUMNS)
    return stats.select("name", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


# -- accuracy: truth Te1, prediction qty and tax based ---------------------------



def pair():
    return F.col("Te1"), F.col("pred")


def dev():
    return F.col("pred") - F.col("Te1")


R2_SQL = "1 - sum(pow(Te1 - pred, 2)) / (var_pop(Te1) * count(*))"


def per_flag(name, columns: dict, sql: dict, digits=6):
    text = ", ".join(f"{rnd(e, digits)} AS {n}" for n, e in sql.items())

    @query(name, with_obs(f"SELECT flag, {text} FROM obs GROUP BY flag"))
    def _(t):
        aggs = [F.round(c(), digits).alias(n) for n, c in columns.items()]
        return t.obs.groupBy("flag").agg(*aggs)


WITHIN_SQL = {f"within_{k}": f"100 * avg(CASE WHEN abs(pred - Te1) <= {k} THEN 1.0 ELSE 0.0 END)" for k in ABSOLUTE_THRESHOLDS}
PERCENT_SQL = {
    f"within_{k}_percent": f"100 * avg(CASE WHEN abs(pred - Te1) / Te1 * 100 <= {k} THEN 1.0 ELSE 0.0 END)"
    for k in RELATIVE_THRESHOLDS
}

per_flag("a3_r_squared", {"r2": lambda: S.r_squared(*pair())}, {"r2": R2_SQL})
per_flag("a4_rmse", {"rmse": lambda: S.rmse(*pair())}, {"rmse": "sqrt(avg(pow(Te1 - pred, 2)))"}, 5)
per_flag("a5_mean_deviation", {"d": lambda: S.mean_deviation(*pair())}, {"d": "avg(pred - Te1)"}, 5)
per_flag(
    "a6_within_absolute",
    {f"within_{k}": (lambda k=k: S.within_absolute(*pair(), k)) for k in ABSOLUTE_THRESHOLDS},
    WITHIN_SQL,
)
per_flag(
    "a7_within_relative",
    {f"within_{k}_percent": (lambda k=k: S.within_relative(*pair(), k)) for k in RELATIVE_THRESHOLDS},
    PERCENT_SQL,
)

REPORT_SQL = {
    "r2": rnd(R2_SQL),
    "rmse": rnd("sqrt(avg(pow(Te1 - pred, 2)))", 5),
    "mean_deviation": rnd("avg(pred - Te1)", 5),
    **{n: rnd(e) for n, e in {**WITHIN_SQL, **PERCENT_SQL}.items()},
}


def round_report(df):
    coarse = {"rmse": 5, "mean_deviation": 5}
    skip = ("n",)
    return df.withColumns(
        {c: F.round(c, coarse.get(c, 6)) for c, k in df.dtypes if k == "double" and c not in skip}
    )


@query(
    "a26_accuracy_report",
    with_obs("SELECT status, count(*) AS n, " + ", ".join(f"{e} AS {n}" for n, e in REPORT_SQL.items()) + " FROM obs GROUP BY status"),
)
def _(t):
    return round_report(S.accuracy_report(t.obs, "Te1", "pred", ["status"]))


@query(
    "a26_accuracy_report_long",
    with_obs(
        ", r AS (SELECT count(*)::DOUBLE AS n, " + ", ".join(f"{e} AS {n}" for n, e in REPORT_SQL.items()) + " FROM obs)"
        " UNPIVOT r ON COLUMNS(*) INTO NAME metric VALUE value"
    ).replace(" UNPIVOT", " SELECT * FROM (UNPIVOT")
    + ")",
)
def _(t):
    return S.long_report(round_report(S.accuracy_report(t.obs, "Te1", "pred")))


SCORES = (
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),"
    " p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e) "
)


@query(
    "a8_mean_entropy",
    SCORES + f"SELECT label, {rnd('avg(h)')} AS mean_entropy FROM (SELECT vec_id, label, -sum(p * ln(p + 1e-10)) AS h FROM p GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    from lagfield.functions.transforms import entropy, softmax

    z = t.embeddings.select("label", entropy(softmax(F.col("embedding").cast("array<double>"))).alias("h"))
    return z.groupBy("label").agg(F.round(F.avg("h"), 6).alias("mean_entropy"))


@query("a9_mean_cross_entropy", SCORES + f"SELECT {rnd('avg(-ln(p))')} AS loss FROM p WHERE i = label")
def _(t):
    z = t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("z"))
    return S.mean_loss(z, "z", "label").select(F.round("loss", 6).alias("loss"))


# -- histograms ------------------------------------------------------------------

# NaN, null and infinity are planted; none of them has a place in a histogram.
ODD = "(line IN (5, 6) OR part % 97 = 0)"
DEV = f", d AS (SELECT *, CASE WHEN NOT {ODD} THEN pred - Te1 END AS dev FROM obs)"


def planted(c):
    nan, endless = F.lit(float("nan")), F.lit(float("inf"))
    odd = F.when(F.col("line") == 5, nan).when(F.col("line") == 6, None).when(F.col("part") % 97 == 0, endless)
    return F.when(F.expr(ODD), odd).otherwise(c)


@query(
    "a10_histogram",
    with_obs(
        DEV + ", m AS (SELECT min(dev) AS lo, max(dev) AS hi FROM d),"
        f" c AS (SELECT {bin_of('dev', 'lo', 'hi', 50)} AS bin, count(*) AS n FROM d, m WHERE dev IS NOT NULL GROUP BY 1)"
        f" SELECT CAST(b AS INTEGER) AS bin, {rnd('lo + b * ((hi - lo) / 50)', 4)} AS low,"
        f" {rnd('lo + (b + 1) * ((hi - lo) / 50)', 4)} AS high, coalesce(n, 0) AS n"
        " FROM m CROSS JOIN (SELECT unnest(range(50)) AS b) LEFT JOIN c ON c.bin = b"
    ),
)
def _(t):
    h = A.histogram(t.obs.withColumn("dev", planted(dev())), "dev", 50)
    return h.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "a11_histogram_2d",
    with_obs(
        DEV + ", m AS (SELECT min(Te1) AS xl, max(Te1) AS xh, min(dev) AS yl, max(dev) AS yh FROM d WHERE dev IS NOT NULL)"
        f" SELECT {bin_of('Te1', 'xl', 'xh', 100)} AS x_bin, {bin_of('dev', 'yl', 'yh', 100)} AS y_bin, count(*) AS n"
        " FROM d, m WHERE dev IS NOT NULL GROUP BY 1, 2"
    ),
)
def _(t):
    return A.histogram_2d(t.obs.withColumn("dev", planted(dev())), "Te1", "dev", 100)


@query(
    "a12_binned_mean",
    with_obs(
        DEV + ", m AS (SELECT min(Te1) AS lo, max(Te1) AS hi FROM d),"
        f" c AS (SELECT {bin_of('Te1', 'lo', 'hi', 50)} AS bin, avg(dev) AS v FROM d, m GROUP BY 1)"
        f" SELECT CAST(b AS INTEGER) AS bin, {rnd('((lo + b * ((hi - lo) / 50)) + (lo + (b + 1) * ((hi - lo) / 50))) / 2', 4)} AS centre,"
        f" {rnd('v', 4)} AS mean FROM m CROSS JOIN (SELECT unnest(range(50)) AS b) LEFT JOIN c ON c.bin = b"
    ),
)
def _(t):
    m = A.binned_mean(t.obs.withColumn("dev", planted(dev())), "Te1", "dev", 50)
    return m.withColumns({"centre": F.round("centre", 4), "mean": F.round("mean", 4)})


@query(
    "a13_shared_bounds_histogram",
    with_obs(
        f", v AS (SELECT * FROM obs WHERE Te1 >= 0 AND pred >= 0 AND NOT {ODD}),"
        " m AS (SELECT least(min(Te1), min(pred)) AS lo, greatest(max(Te1), max(pred)) AS hi FROM v WHERE status = 'F')"
        f" SELECT * FROM (SELECT status, {bin_of('pred', 'lo', 'hi', 100)} AS pred_bin, {bin_of('Te1', 'lo', 'hi', 100)} AS obs_bin,"
        " count(*) AS n FROM v, m GROUP BY 1, 2, 3) WHERE pred_bin IS NOT NULL AND obs_bin IS NOT NULL"
    ),
)
def _(t):
    return A.shared_histogram(t.obs.withColumn("pred", planted(F.col("pred"))), "Te1", "pred", "status", "F", 100)


HEAT = {**HEATMAP_RANGES, "GMLT": None}  # local time over its own range
HEAT_SQL = with_obs(
    ", g AS (SELECT *, CASE WHEN pow(cos(radians(ILAT)), 2) >= 1e-9 AND abs(ILAT) < 90 THEN 1 / pow(cos(radians(ILAT)), 2) END AS L"
    " FROM obs WHERE Te1 > 0),"
    " y AS (SELECT greatest(0, quantile_cont(Te1, 0.01)) AS yl, quantile_cont(Te1, 0.999) AS yh, min(GMLT) AS gl, max(GMLT) AS gh FROM g),"
    " p AS (SELECT 'L' AS param, L AS x, 1e0 AS xl, 12e0 AS xh, Te1, yl, yh FROM g, y"
    " UNION ALL SELECT 'GLAT', GLAT, -90e0, 90e0, Te1, yl, yh FROM g, y UNION ALL SELECT 'GMLT', GMLT, gl, gh, Te1, yl, yh FROM g, y),"
    f" c AS (SELECT param, {bin_of('x', 'xl', 'xh', 100)} AS x_bin, {bin_of('Te1', 'yl', 'yh', 100)} AS y_bin, count(*) AS n"
    " FROM p WHERE x IS NOT NULL GROUP BY 1, 2, 3)"
    " SELECT *, max(n) OVER () AS max_n FROM c WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL"
)


@query("a14_parameter_heatmaps", HEAT_SQL)
def _(t):
    return observation_heatmaps(t.obs, "Te1", 100, HEAT)


# -- profiles ----------------------------------------------------------------------


def profile_sql(rows: str, ilat: str) -> str:
    return (
        f" r AS ({rows}), b AS (SELECT * FROM r WHERE {ilat} AND Te1 > 0 AND Altitude > 0),"
        " s AS (SELECT 'day' AS sector, * FROM b WHERE GMLT > 10 AND GMLT < 17 UNION ALL"
        " SELECT 'night', * FROM b WHERE GMLT > 22 OR GMLT < 4 UNION ALL SELECT 'all', * FROM b),"
        " m AS (SELECT *, max(Altitude) OVER (PARTITION BY sector) AS top FROM s)"
        " SELECT sector, floor(Altitude / 20) * 20 AS bin_low,"
        f" {rnd('avg(Te1)', 4)} AS mean_te, {rnd('min(Te1)', 4)} AS min_te, {rnd('max(Te1)', 4)} AS max_te, {rnd('avg(Altitude)', 4)} AS mean_alt,"
        f" count(*) AS n, {rnd('avg(Te1) - min(Te1)', 4)} AS error_low, {rnd('max(Te1) - avg(Te1)', 4)} AS error_high"
        " FROM m WHERE floor(Altitude / 20) * 20 < top GROUP BY 1, 2 HAVING count(*) >= 10"
    )


def round_profile(df):
    return df.withColumns(
        {c: F.round(c, 4) for c in ("mean_te", "min_te", "max_te", "mean_alt", "error_low", "error_high")}
    )


@query(
    "a15_altitude_profile",
    with_obs("," + profile_sql("SELECT * FROM obs", "ILAT BETWEEN 40 AND 50")),
)
def _(t):
    return round_profile(profiles.altitude_profile(t.obs))


CENTRE = (
    "CASE WHEN ILAT >= 0 AND ILAT < 90 THEN CASE WHEN ILAT <= 25 THEN 20e0 WHEN ILAT <= 35 THEN 30e0"
    " WHEN ILAT <= 45 THEN 40e0 ELSE 50e0 END END"
)
PART = "CASE WHEN hour(ts) BETWEEN 9 AND 15 THEN 'Day' WHEN hour(ts) >= 21 OR hour(ts) < 4 THEN 'Night' END"


@query(
    "a16_nearest_centre_means",
    with_obs(
        f", c AS (SELECT {CENTRE} AS centre, {PART} AS part, Te1, qty FROM obs WHERE ILAT BETWEEN 15 AND 55),"
        " f AS (SELECT unnest([20e0, 30e0, 40e0, 50e0]) AS centre), p AS (SELECT unnest(['Day', 'Night']) AS part)"
        f" SELECT f.centre, p.part, {rnd('avg(Te1)', 4)} AS mean_Te1, {rnd('avg(qty)', 4)} AS mean_qty"
        " FROM f CROSS JOIN p LEFT JOIN c ON c.centre = f.centre AND c.part = p.part GROUP BY 1, 2"
    ),
)
def _(t):
    rows = t.obs.where(F.col("ILAT").between(15, 55)).drop("part")
    m = profiles.nearest_centre_means(rows, "ts", "ILAT", ["Te1", "qty"])
    return m.withColumns({"mean_Te1": F.round("mean_Te1", 4), "mean_qty": F.round("mean_qty", 4)})


BUCKET = 50_000


@query("a17_yearly_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return profiles.yearly_counts(t.orders, "o_orderdate")


@query(
    "a17_bucket_counts",
    f"""WITH b AS (SELECT unnest(range(0, (SELECT CAST(trunc(max(o_totalprice)) AS BIGINT) FROM orders), {BUCKET})) AS bucket),
        c AS (SELECT CAST((ceil(o_totalprice / {BUCKET}) - 1) * {BUCKET} AS BIGINT) AS bucket, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1)
        SELECT b.bucket, CAST(b.bucket AS VARCHAR) || '-' || CAST(b.bucket + {BUCKET} - 1 AS VARCHAR) AS label, coalesce(n, 0) AS n
        FROM b LEFT JOIN c USING (bucket)""",
)
def _(t):
    return profiles.bucket_counts(t.orders, "o_totalprice", BUCKET)


# -- percentiles -----------------------------------------------------------------------


def box_sql(source: str, bucket: str, columns, name: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, {bucket} AS b, {c} AS v FROM {source}" for c in columns)
    return (
        f"WITH l AS (SELECT * FROM ({long}) WHERE v IS NOT NULL AND b IS NOT NULL), q AS (SELECT col, b, count(*) AS n,"
        " quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2)"
        f" SELECT col AS \"column\", b AS {name}, any_value(n) AS n, {rnd('any_value(q1)', 5)} AS q1, {rnd('any_value(q2)', 5)} AS median,"
        f" {rnd('any_value(q3)', 5)} AS q3, {rnd('min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 5)} AS low_whisker,"
        f" {rnd('max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 5)} AS high_whisker,"
        " count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM l JOIN q USING (col, b) GROUP BY 1, 2"
    )


def round_box(df):
    return df.withColumns({c: F.round(c, 5) for c in ("q1", "median", "q3", "low_whisker", "high_whisker")})


@query(
    "a18_box_summary_by_year",
    box_sql("lineitem", "CAST(year(l_shipdate) AS INTEGER)", ["l_extendedprice", "l_quantity", "l_discount"], "year"),
)
def _(t):
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    return round_box(percentiles.box_summary(t.lineitem, cols, F.year("l_shipdate"), "year"))


@query(
    "a18_box_summary_by_bucket",
    box_sql("orders", f"CAST((ceil(o_totalprice / {BUCKET}) - 1) * {BUCKET} AS BIGINT)", ["o_totalprice", "o_custkey"], "bucket"),
)
def _(t):
    low = profiles.bucket_of("o_totalprice", BUCKET)
    return round_box(percentiles.box_summary(t.orders, ["o_totalprice", "o_custkey"], low, "bucket"))




def describe_sql(columns) -> str:
    rows = []
    for c in columns:
        items = {
            "count": f"count({c})::DOUBLE",
            "mean": f"avg({c})",
            "std": f"stddev_samp({c})",
            "min": f"min({c})",
            "max": f"max({c})",
            **{f"p{p}": f"quantile_cont({c}, {p})" for p in DESCRIBE_PERCENTILES},
        }
        rows += [f"SELECT '{c}' AS \"column\", '{k}' AS statistic, {rnd(e, 4)} AS value FROM obs" for k, e in items.items()]
    return with_obs(" UNION ALL ".join(rows))


@query("a19_describe", describe_sql(["Te1", "Altitude", "GMLT", "XXLAT"]))
def _(t):
    d = percentiles.describe(t.obs, ["Te1", "Altitude", "GMLT", "XXLAT"], DESCRIBE_PERCENTILES)
    return d.withColumn("value", F.round("value", 4))


@query(
    "a20_exact_percentiles",
    with_obs(
        " UNION ALL ".join(
            f"SELECT flag, {p}e0 AS p, {rnd(f'quantile_cont(Te1, {p})', 5)} AS value FROM obs GROUP BY flag"
            for p in (0, 0.01, 0.5, 0.999, 1)
        )
    ),
)
def _(t):
    # The two-pass way, whatever the size of the input.
    q = percentiles.exact_percentiles(t.obs, "Te1", [0.0, 0.01, 0.5, 0.999, 1.0], ["flag"])
    return q.withColumn("value", F.round("value", 5))


@query(
    "a21_null_counts",
    with_obs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS non_nulls, '{k}' AS type FROM obs"
            for c, k in (("XXLAT", "double"), ("Te1", "double"), ("flag", "string"))
        )
    ),
)
def _(t):
    return null_counts(t.obs, ["XXLAT", "Te1", "flag"])


# -- keys ---------------------------------------------------------------------------


@query(
    "a22_first_per_key",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1",
)
def _(t):
    return keyed.first_per_key(t.orders, ["o_custkey"], F.col("o_orderkey"), ["o_orderkey", "o_totalprice"])


@query("a23_full_row_distinct", "SELECT DISTINCT l_shipdate, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_shipdate", "l_returnflag", "l_linestatus").distinct()


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "a24_pivot_cells",
    "SELECT hour(ts)::INTEGER AS h, "
    + ", ".join(f"{rnd(f'''max(value) FILTER (event_type = '{k}')''', 4)} AS {k}" for k in KINDS)
    + " FROM events GROUP BY 1",
)
def _(t):
    cells = t.events.groupBy(F.hour("ts").alias("h"), "event_type").agg(F.max("value").alias("v"))
    wide = keyed.pivot_cells(cells, "h", "event_type", "v", KINDS)
    return wide.withColumns({k: F.round(k, 4) for k in KINDS})


@query(
    "a24_dense_cells",
    "SELECT h, list(v ORDER BY m) AS cells FROM (SELECT h, m, " + rnd("max(value)", 4) + " AS v"
    " FROM (SELECT DISTINCT hour(ts)::INTEGER AS h FROM events) CROSS JOIN (SELECT unnest(range(60)) AS m)"
    " LEFT JOIN events ON hour(ts) = h AND minute(ts) = m GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    cells = t.events.groupBy(F.hour("ts").alias("h"), F.minute("ts").alias("m")).agg(F.round(F.max("value"), 4).alias("v"))
    return keyed.pivot_dense(cells, "h", F.col("m"), "v", 60)


@query("a25_extent", with_obs("SELECT min(Altitude) AS low, max(Altitude) AS high FROM obs"))
def _(t):
    return S.extent(t.obs, "Altitude")
