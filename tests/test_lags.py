"""Lag gathers and nearest look-ups against pandas reindexing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagfield.operators import lags as J
from lagfield.schema import MICROS_PER_HOUR, MICROS_PER_MINUTE, LagSpec

START = pd.Timestamp("1991-01-01")


def to_spark(spark, pdf, time_columns):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in time_columns})


@pytest.fixture(scope="module")
def minute_case(spark):
    rng = np.random.default_rng(7)
    index = pd.date_range(START, periods=3000, freq="min")
    keep = rng.random(len(index)) > 0.2  # gaps
    series = pd.DataFrame({"ts": index[keep], "v": rng.normal(size=keep.sum()).round(4)})
    minutes = rng.integers(-400, 3600, size=700)
    minutes[:250] = 1234  # one instant holds a third of all rows
    rows = pd.DataFrame({"id": np.arange(700), "t": START + pd.to_timedelta(minutes, unit="m")})
    rows.loc[5, "t"] = pd.NaT
    rows.loc[6, "t"] = START + pd.Timedelta("00:20:30")  # off the grid
    return series, rows


def expected_lags(series, rows, step, count, unit, rounding=False, nearest=False):
    s = series.set_index("ts")["v"].sort_index()
    out = {}
    for r in rows.itertuples():
        at = pd.DatetimeIndex([r.t - k * step * unit for k in range(count)])
        if rounding:
            at = at.round("h")
        if pd.isna(r.t):
            out[r.id] = [None] * count
            continue
        got = s.reindex(at, method="nearest") if nearest else s.reindex(at)
        out[r.id] = [None if pd.isna(x) else float(x) for x in got]
    return out


def collected(df, column="lag"):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("limit", [J.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("step,count", [(10, 31), (30, 145), (7, 3), (1, 1)])
def test_blocks_equal_reindex(spark, minute_case, limit, step, count):
    series, rows = minute_case
    spec = LagSpec(MICROS_PER_MINUTE, step, count)
    got = J.attach_lags(
        to_spark(spark, rows, ["t"]), "t", [(to_spark(spark, series, ["ts"]), "ts", "v", "lag", spec)], limit
    )
    assert collected(got) == expected_lags(series, rows, step, count, pd.Timedelta("1min"))


def test_join_strategy_equals_reindex(spark, minute_case):
    series, rows = minute_case
    spec = LagSpec(MICROS_PER_MINUTE, 9, 11)
    got = J.attach_lags_by_join(
        to_spark(spark, rows, ["t"]), "t", to_spark(spark, series, ["ts"]), "ts", "v", "lag", spec
    )
    assert collected(got) == expected_lags(series, rows, 9, 11, pd.Timedelta("1min"))


def hourly_case(rng, n=500):
    index = pd.date_range(START, periods=400, freq="h")
    keep = rng.random(len(index)) > 0.4
    series = pd.DataFrame({"ts": index[keep], "v": rng.normal(size=keep.sum()).round(4)})
    series.loc[3, "v"] = np.nan  # the nearest key counts even without a value
    minutes = rng.integers(-3000, 400 * 60 + 3000, size=n)
    minutes[:60] = 30 + 60 * np.arange(60)  # exact halves
    return series, pd.DataFrame({"id": np.arange(n), "t": START + pd.to_timedelta(minutes, unit="m")})


def null_frame(spark, series):
    df = to_spark(spark, series, ["ts"])
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_rounded_blocks_equal_reindex(spark):
    series, rows = hourly_case(np.random.default_rng(3))
    spec = LagSpec(MICROS_PER_HOUR, 24, 4, half_even=True)
    got = J.attach_lags(to_spark(spark, rows, ["t"]), "t", [(null_frame(spark, series), "ts", "v", "lag", spec)])
    assert collected(got) == expected_lags(series, rows, 24, 4, pd.Timedelta("1h"), rounding=True)


def test_odd_rounded_steps_go_through_the_join(spark):
    series, rows = hourly_case(np.random.default_rng(4), 120)
    spec = LagSpec(MICROS_PER_HOUR, 3, 5, half_even=True)
    args = to_spark(spark, rows, ["t"]), "t"
    with pytest.raises(ValueError):
        J.attach_lags(*args, [(null_frame(spark, series), "ts", "v", "lag", spec)])
    got = J.attach_lags_by_join(*args, null_frame(spark, series), "ts", "v", "lag", spec)
    assert collected(got) == expected_lags(series, rows, 3, 5, pd.Timedelta("1h"), rounding=True)


def test_nearest_lags_equal_reindex(spark):
    series, rows = hourly_case(np.random.default_rng(5), 200)
    spec = LagSpec(MICROS_PER_HOUR, 24, 4, half_even=True)
    got = J.attach_nearest_lags(to_spark(spark, rows, ["t"]), "t", null_frame(spark, series), "ts", "v", "lag", spec)
    assert collected(got) == expected_lags(series, rows, 24, 4, pd.Timedelta("1h"), rounding=True, nearest=True)


def test_nearest_equals_reindex(spark):
    rng = np.random.default_rng(11)
    keys = np.unique(rng.integers(0, 20 * 86_400, size=60))
    keys = np.concatenate([keys, keys[-1] + 40 * 86_400 + np.array([0, 7])])  # a long gap
    series = pd.DataFrame({"ts": START + pd.to_timedelta(keys, unit="s"), "v": np.arange(len(keys)) * 1.0})
    at = np.concatenate([rng.integers(-3 * 86_400, 70 * 86_400, size=800), keys[:30], (keys[1:] + keys[:-1]) // 2])
    rows = pd.DataFrame({"id": np.arange(len(at)), "t": START + pd.to_timedelta(at, unit="s")})
    got = J.attach_nearest(
        to_spark(spark, rows, ["t"]), "t", to_spark(spark, series, ["ts"]), "ts", "v", "lag"
    )
    want = series.set_index("ts")["v"].reindex(pd.DatetimeIndex(rows["t"]), method="nearest")
    assert collected(got) == dict(zip(rows["id"], want.astype(float)))


def test_nearest_with_clusters_and_a_far_key(spark):
    rng = np.random.default_rng(12)
    dense = np.unique(rng.integers(0, 3000, size=1500))  # about every two seconds
    minutes = 10_000 + 60 * np.arange(2000)
    keys = np.concatenate([dense, minutes, [5_500_000_000]])  # and one some 170 years on
    series = pd.DataFrame({"ts": START + pd.to_timedelta(keys, unit="s"), "v": np.arange(len(keys)) * 1.0})
    at = np.concatenate([rng.integers(-99, 140_000, size=900), [3_000_000_000, 5_400_000_000, 5_600_000_000]])
    rows = pd.DataFrame({"id": np.arange(len(at)), "t": START + pd.to_timedelta(at, unit="s")})
    obs, ser = to_spark(spark, rows, ["t"]), to_spark(spark, series, ["ts"]).repartition(5)
    got = J.attach_nearest(obs, "t", ser, "ts", "v", "lag", key_out="at")
    right = np.searchsorted(keys, at).clip(0, len(keys) - 1)
    left = (right - 1).clip(0)
    want = np.where(np.abs(keys[right] - at) <= np.abs(at - keys[left]), right, left)
    assert collected(got.drop("at")) == dict(zip(rows["id"], want.astype(float)))
    near, _, _ = J._with_neighbours(ser, "ts", "v")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_rows_without_a_time_have_no_nearest(spark):
    rows = spark.sql("SELECT 1 AS id, CAST(NULL AS timestamp_ntz) AS t")
    series = to_spark(spark, pd.DataFrame({"ts": [START], "v": [2.0]}), ["ts"])
    assert collected(J.attach_nearest(rows, "t", series, "ts", "v", "lag")) == {1: None}


def test_nearest_in_an_empty_series_is_null(spark):
    rows = to_spark(spark, pd.DataFrame({"id": [1], "t": [START]}), ["t"])
    empty = spark.createDataFrame([], "ts timestamp_ntz, v double")
    assert collected(J.attach_nearest(rows, "t", empty, "ts", "v", "lag")) == {1: None}


def test_observations_are_not_shuffled_when_blocks_fit(spark, minute_case):
    series, rows = minute_case
    spec = LagSpec(MICROS_PER_MINUTE, 10, 31)
    obs = to_spark(spark, rows, ["t"])
    got = J.attach_lags(obs, "t", [(to_spark(spark, series, ["ts"]), "ts", "v", "lag", spec)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1
    assert plan.count("Exchange hashpartitioning") == 1  # the series' own grouping


def test_doubled_series_instants_fail(spark, minute_case):
    series, rows = minute_case
    twice = pd.concat([series, series.iloc[[40]]])
    spec = LagSpec(MICROS_PER_MINUTE, 10, 31)
    got = J.attach_lags(
        to_spark(spark, rows, ["t"]), "t", [(to_spark(spark, twice, ["ts"]), "ts", "v", "lag", spec)]
    )
    with pytest.raises(Exception):
        got.collect()
