import math

import numpy as np
import pandas as pd
import pytest

from lagfield.operators import histograms, profiles


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.gamma(2.0, 900.0, size=4000), np.arange(0, 500, 0.1)])
    return x, rng.normal(size=len(x)).round(2)


def test_histogram_equals_numpy(spark, points):
    x, _ = points
    got = histograms.histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 50).orderBy("bin").toPandas()
    n, edges = np.histogram(x, bins=50)
    assert got["n"].tolist() == n.tolist()
    assert np.allclose(got["low"], edges[:-1]) and np.allclose(got["high"], edges[1:])


def test_single_value_histogram(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    got = histograms.histogram(df, "x", 4).orderBy("bin").toPandas()
    assert got["n"].tolist() == np.histogram([2.0, 2.0], bins=4)[0].tolist()


def test_histogram_2d_equals_numpy(spark, points):
    x, y = points
    got = histograms.histogram_2d(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y", 100).toPandas()
    n, _, _ = np.histogram2d(x, y, bins=100)
    dense = np.zeros((100, 100))
    dense[got["x_bin"], got["y_bin"]] = got["n"]
    assert (dense == n).all()


def test_binned_mean(spark, points):
    x, y = points
    got = histograms.binned_mean(spark.createDataFrame(pd.DataFrame({"x": x, "v": y})), "x", "v", 50).orderBy("bin").toPandas()
    edges = np.linspace(x.min(), x.max(), 51)
    k = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, 49)
    want = pd.Series(y).groupby(k).mean().reindex(range(50))
    assert np.allclose(got["mean"].astype(float), want, equal_nan=True)


def test_profile_drops_the_open_last_edge(spark):
    rows = [(a, 2000.0 + a, 45.0, 12.0) for a in (1000.0, 1005.0, 7990.0, 8000.0) for _ in range(12)]
    df = spark.createDataFrame(rows, "Altitude double, Te1 double, ILAT double, GMLT double")
    got = {(r.sector, r.bin_low): r.n for r in profiles.altitude_profile(df).collect()}
    assert got == {(s, b): n for s in ("day", "all") for b, n in ((1000.0, 24), (7980.0, 12))}


def test_buckets_are_right_closed_and_dense(spark):
    x = [0.0, 500.0, 1000.0, 1000.5, 3200.0, 3999.0]
    got = profiles.bucket_counts(spark.createDataFrame([(v,) for v in x], "x double"), "x", 1000).orderBy("bucket").collect()
    cut = pd.cut(pd.Series(x), bins=range(0, 4999, 1000)).value_counts(sort=False)
    assert [r.n for r in got] == cut.tolist()
    assert [r.label for r in got] == ["0-999", "1000-1999", "2000-2999", "3000-3999"]


def test_nan_null_and_infinity_are_left_out(spark):
    odd = [float("nan"), None, float("inf"), float("-inf")]
    rows = [(float(i), float(i % 7), "F") for i in range(50)] + [(x, 1.0, "F") for x in odd] + [(1.0, x, "F") for x in odd]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    h = histograms.histogram(df, "x", 10).collect()
    assert sum(r.n for r in h) == 54 and all(math.isfinite(r.low) and 0 <= r.bin < 10 for r in h)
    cells = histograms.histogram_2d(df, "x", "y", 10).collect()
    assert sum(r.n for r in cells) == 50 and min(r.x_bin for r in cells) == 0
    assert all(math.isfinite(r.mean) for r in histograms.binned_mean(df, "x", "y", 10).collect() if r.mean is not None)
    pairs = histograms.shared_histogram(df, "x", "y", "s", "F", 10).collect()
    assert sum(r.n for r in pairs) == 50 and min(r.pred_bin for r in pairs) == 0
