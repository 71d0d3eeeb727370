"""Scans and sinks. Files are written by Spark from the given tables into the shared
scratch folder, then read back by the scan under test."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.catalog.base import query, rnd, with_obs
from lagfield.operators.sampling import ranked
from lagfield.operators.statistics import pooled_stats
from lagfield.plans.dataset import split_features
from lagfield.session import scratch
from lagfield.sources import readers as R
from lagfield.sources import writers as S

TSV_SCHEMA = T.StructType(
    [
        T.StructField("DateFormatted", T.StringType()),
        T.StructField("TimeFormatted", T.StringType()),
        T.StructField("okey", T.LongType()),
        T.StructField("Altitude", T.DoubleType()),
        T.StructField("Te1", T.DoubleType()),
    ]
)


@query(
    "s1_tsv_observation_scan",
    with_obs(
        "SELECT okey, CASE WHEN line <> 2 THEN date_trunc('day', ts) END AS DateFormatted,"
        " strftime(ts, '%H:%M:%S') AS TimeFormatted, CASE WHEN line <> 3 THEN Altitude END AS Altitude, Te1 FROM obs"
    ),
)
def _(t):
    path = scratch(t.spark, "tsv")
    rows = t.obs.select(
        F.when(F.col("line") == 2, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("DateFormatted"),
        F.col("Te1").cast("string").alias("Te1"),  # header order differs from the schema's
        "okey",
        F.date_format("ts", "HH:mm:ss").alias("TimeFormatted"),
        F.when(F.col("line") == 3, "NaN").otherwise(F.col("Altitude").cast("string")).alias("Altitude"),
    )
    rows.write.option("sep", "\t").option("header", True).csv(path)
    df = R.scan_observations(t.spark, path, TSV_SCHEMA)
    return df.select("okey", "DateFormatted", "TimeFormatted", "Altitude", "Te1")


def _index_lines(t, kind: str):
    """Index files of one kind: fixed columns, one folder per event type."""
    ev = t.events.select("event_id", "ts", "value", "event_type")
    year, doy = F.year("ts").cast("string"), F.dayofyear("ts").cast("string")
    hour, minute = F.hour("ts").cast("string"), F.minute("ts").cast("string")
    value = F.format_string("%.2f", "value")
    masked = F.when(F.col("value") < 5, F.lit("999.9")).otherwise(value)
    parts = {
        "minute": [year, doy, hour, minute, masked, F.lit("-5")],
        "hour": [year, doy, hour, masked],
    }[kind]
    return ev.select("event_type", "event_id", "ts", F.concat_ws("   ", F.lit(""), *parts).alias("value"))


def _write_lines(lines, path):
    """One file per event type, in event order within the file."""
    ordered = lines.repartition("event_type").sortWithinPartitions("event_type", "event_id")
    ordered.select("event_type", "value").write.partitionBy("event_type").text(path)


# First line per instant in (folder, line) order: event type, then event id.
FIRST_MINUTE = """SELECT date_trunc('{unit}', ts) AS ts, arg_min({value}, event_type || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS {name}{more}
 FROM events {where} GROUP BY 1"""
MASKED = "CASE WHEN value < 5 THEN {gap} ELSE round(value, 2) END"


def _first_sql(unit, name, gap="999.9", more="", where=""):
    # arg_min skips nulls, so a null reading travels as -1e9 and is turned back.
    value = MASKED.format(gap=gap if gap != "NULL" else "-1e9")
    inner = FIRST_MINUTE.format(unit=unit, value=value, name="v", more=more, where=where)
    return f"SELECT ts, nullif(v, -1e9) AS {name}{', SYM_H' if more else ''} FROM ({inner})"


@query("s2_index_file_scan", _first_sql("minute", "AL_index", more=", -5e0 AS SYM_H"))
def _(t):
    path = scratch(t.spark, "minute")
    _write_lines(_index_lines(t, "minute"), path)
    return R.scan_minute_indices(t.spark, f"{path}/*/*.txt")


@query("s3_hourly_flux_scan", _first_sql("hour", "f107_index"))
def _(t):
    path = scratch(t.spark, "flux")
    _write_lines(_index_lines(t, "hour"), path)
    return R.scan_flux(t.spark, f"{path}/*/*.txt")


@query("s4_kp_scan", _first_sql("hour", "Kp_index"))
def _(t):
    path = scratch(t.spark, "kp")
    _write_lines(_index_lines(t, "hour"), path)
    return R.scan_kp(t.spark, f"{path}/*/*.txt")


@query("s5_bad_file_quarantine", _first_sql("minute", "AL_index", more=", -5e0 AS SYM_H", where="WHERE event_type <> 'error'"))
def _(t):
    path = scratch(t.spark, "quarantine")
    lines = _index_lines(t, "minute")
    # Every line of one folder's file gets a broken hour field.
    broken = F.when(F.col("event_type") == "error", F.regexp_replace("value", r"^(\s+\S+\s+\S+\s+)\S+", "$1??"))
    _write_lines(lines.withColumn("value", F.coalesce(broken, F.col("value"))), path)
    return R.scan_minute_indices(t.spark, f"{path}/*/*.txt")


@query(
    "s5_damaged_files",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 'broken archive' WHEN 'error' THEN 'not UTF-8'
       WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'a line that cannot be parsed' ELSE '' END AS reason,
       CASE WHEN event_type = 'purchase' THEN count(DISTINCT date_trunc('minute', ts)) ELSE 0 END AS instants
       FROM events GROUP BY event_type""",
)
def _(t):
    """One folder for each kind of damage, made from the files of the event types."""
    path = scratch(t.spark, "damaged")
    kind = F.col("event_type")
    lines = _index_lines(t, "minute")
    broken = F.when(kind == "signup", F.regexp_replace("value", r"^(\s+\S+\s+\S+\s+)\S+", "$1??")).otherwise(F.col("value"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", broken.alias("v")))), lambda x: x["v"]), "\n")
    files = lines.groupBy("event_type").agg(text.alias("text"))

    def put(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            names, data = batch.column(0).to_pylist(), []
            for name, own in zip(names, batch.column(1).to_pylist()):
                packed = gzip.compress(own.encode(), mtime=0)
                data.append({"click": packed[: len(packed) // 2], "error": own.encode("utf-16"), "view": b""}.get(name, own.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], ["event_type", "data"])

    made = files.mapInArrow(put, "event_type string, data binary").collect()  # one small file an event type
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    for r in made:
        at = hadoop.Path(f"{path}/{r.event_type}/part.{'gz' if r.event_type == 'click' else 'txt'}")
        out = at.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(r.data))
        out.close()
    fields = ("Year", "Day", "Hour", "Minute", "AL_index", "SYM_H")
    series, damaged = R.scan_index_reported(t.spark, f"{path}/*/*", fields)
    folder = F.element_at(F.split("file", "/"), -2)
    reasons = damaged.select(folder.alias("event_type"), F.regexp_replace("reason", ":.*", "").alias("reason"))
    good = series.agg(F.lit("purchase").alias("event_type"), F.count("*").alias("instants"))
    kinds = t.events.select("event_type").distinct()
    return (
        kinds.join(reasons, "event_type", "left")
        .join(good, "event_type", "left")
        .select("event_type", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("instants", F.lit(0)).alias("instants"))
    )


@query("s6_sentinel_scan", _first_sql("minute", "AL_index", gap="NULL", more=", -5e0 AS SYM_H", where="WHERE event_type <> 'view'"))
def _(t):
    path = scratch(t.spark, "masked")
    lines = _index_lines(t, "minute")
    # Lines cut short carry no full time: they must be dropped, their file kept.
    cut = F.when(F.col("event_type") == "view", F.substring_index(F.trim("value"), " ", 1)).otherwise(F.col("value"))
    _write_lines(lines.withColumn("value", cut), path)
    return R.scan_minute_indices(t.spark, f"{path}/*/*.txt", mask=True)


@query("s7_input_preflight", "SELECT event_type AS source, 1::BIGINT AS files FROM events GROUP BY 1")
def _(t):
    path = scratch(t.spark, "inventory")
    _write_lines(_index_lines(t, "hour"), path)
    kinds = ["click", "error", "purchase", "signup", "view"]
    return R.inventory(t.spark, {k: f"{path}/event_type={k}/*.txt" for k in kinds}).select("source", "files")


@query("s8_load_split", with_obs("SELECT okey, Te1 FROM obs"))
def _(t):
    base = scratch(t.spark, "splits")
    S.write_split(t.obs.select("okey", "Altitude", "Te1"), base, "test-normal")
    return R.load_split(t.spark, f"{base}/test-normal", ["okey", "Te1", "absent"])


@query("s9_load_all_chunks", with_obs("SELECT okey, Te1, CASE WHEN status = 'O' THEN Altitude END AS Altitude FROM obs"))
def _(t):
    base = scratch(t.spark, "chunks")
    S.write_split(t.obs.where("status = 'O'").select("okey", "Te1", "Altitude"), base, "a/one")
    S.write_split(t.obs.where("status <> 'O'").select("okey", "Te1"), base, "b/two")
    return R.load_all(t.spark, base).select("okey", "Te1", "Altitude")


@query("s10_write_split", with_obs(f"SELECT status, count(*) AS n, {rnd('sum(Te1)', 2)} AS te FROM obs GROUP BY 1"))
def _(t):
    base = scratch(t.spark, "named")
    for s in ("F", "O"):
        S.write_split(t.obs.where(F.col("status") == s), base, f"split-{s}")
    back = R.load_all(t.spark, base)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Te1"), 2).alias("te"))


@query(
    "s11_chunked_write",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rn FROM orders),
       k AS (SELECT greatest(1, count(*) // 6) AS k FROM orders)
       SELECT CAST((rn - 1) // k + 1 AS INTEGER) AS chunk, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r, k GROUP BY 1""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    rows = max(1, df.count() // 6)
    path = S.write_chunks(ranked(df, "o_orderkey"), scratch(t.spark, "numbered"), "rank", rows)
    back = t.spark.read.parquet(path)
    return back.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s12_replace_output", with_obs("SELECT count(*) AS n, max(Te1) AS top FROM obs WHERE status = 'O'"))
def _(t):
    base = scratch(t.spark, "replaced")
    S.write_split(t.obs, base, "out")
    path = S.write_in_files(t.obs.where("status = 'O'"), f"{base}/out", 10_000)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max("Te1").alias("top"))


@query("s13_append_frozen_schema", with_obs("SELECT status, okey, Te1 FROM obs"))
def _(t):
    path = scratch(t.spark, "frozen")
    schema = T.StructType(
        [T.StructField("status", T.StringType()), T.StructField("okey", T.LongType()), T.StructField("Te1", T.DoubleType())]
    )
    for s in ("F", "O", "F"):  # the first batch comes twice
        S.append_frozen(t.obs.where(F.col("status") == s).select("Te1", "okey", "status"), path, schema, batch=s)
    return t.spark.read.parquet(path).drop("batch")


@query(
    "s14_statistics_side_file",
    with_obs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, {rnd(f'avg({c})', 5)} AS mean, {rnd(f'stddev_pop({c})', 5)} AS std FROM obs"
            for c in ("Te1", "GLAT")
        )
    ),
)
def _(t):
    path = scratch(t.spark, "stats")
    compute = lambda: pooled_stats(t.obs, {"Te1": ["Te1"], "GLAT": ["GLAT"]})
    S.load_or_compute_stats(t.spark, path, compute)  # computes and saves
    stats = S.load_or_compute_stats(t.spark, path, compute)  # loads
    return stats.select("name", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(
    "s14_statistics_by_chunk",
    with_obs(
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, {rnd(f'avg({c})', 5)} AS mean, {rnd(f'stddev_pop({c})', 5)} AS std FROM obs"
            for c in ("Te1", "GLAT")
        )
    ),
)
def _(t):
    path = scratch(t.spark, "moments")
    for s in ("F", "O", "F"):  # chunk by chunk, one of them twice
        S.write_moments(t.obs.where(F.col("status") == s), {"Te1": ["Te1"], "GLAT": ["GLAT"]}, path, s)
    return S.read_moments(t.spark, path).select("name", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(
    "k3_split_and_save",
    """WITH h AS (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-31' AND o_orderdate < TIMESTAMP '1998-03-07' THEN 1 ELSE 0 END AS held FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rn FROM h)
       SELECT CASE WHEN held = 1 THEN 'test-storm' WHEN rn <= 500 THEN 'test-normal' ELSE 'train' END AS split,
       count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM r GROUP BY 1""",
)
def _(t):
    from lagfield.plans.dataset import save_splits

    base = scratch(t.spark, "dataset")
    parts = split_features(t.orders, "o_orderkey", "1998-01-31", "1998-03-07", 500, ts="o_orderdate")
    save_splits(parts, base, "o_orderkey", 5000)
    frames = [
        t.spark.read.parquet(f"{base}/{d}").withColumn("split", F.lit(s))
        for d, s in (("test-storm", "test-storm"), ("test-normal", "test-normal"), ("train_chunks", "train"))
    ]
    return (
        R.union_all(frames)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("o_orderkey").alias("keys"),
            F.min("o_orderdate").alias("first_ts"),
            F.max("o_orderdate").alias("last_ts"),
        )
    )
