import numpy as np
import pandas as pd
import pytest

from lagfield.operators import percentiles

PROBS = [0.0, 0.005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999, 1.0]


def values(kind, n=40_000):
    rng = np.random.default_rng(1)
    if kind == "normal":
        return rng.normal(size=n)
    if kind == "third equal":
        v = rng.normal(size=n)
        v[: n // 3] = 0.25
        return v
    if kind == "outliers":
        return np.concatenate([rng.normal(size=n - 2), [1e12, -1e12]])
    if kind == "constant":
        return np.full(n, 3.5)
    return rng.integers(0, 5, size=n).astype(float)


@pytest.mark.parametrize("kind", ["normal", "third equal", "outliers", "constant", "few values"])
def test_equal_to_numpy(spark, kind):
    v = values(kind)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 10 == 0, "x": v}))
    got = percentiles.exact_percentiles(df, "x", PROBS, ["g"]).collect()
    assert len(got) == 2 * len(PROBS)
    for r in got:
        part = v[(np.arange(len(v)) % 10 == 0) == r.g]
        assert r.value == pytest.approx(np.percentile(part, r.p * 100), rel=1e-12, abs=1e-12)


def test_nan_and_null_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert percentiles.exact_percentiles(df, "x", [0.5]).first().value == 2.0
    assert percentiles.exact_percentiles(df.where("x > 9"), "x", [0.5]).count() == 0


def test_describe_equals_pandas(spark):
    v = values("normal", 3000)
    df = spark.createDataFrame(pd.DataFrame({"a": v, "b": v * 2 + 1}))
    got = {(r.column, r.statistic): r.value for r in percentiles.describe(df, ["a", "b"], [0.005, 0.5, 0.999]).collect()}
    for column, series in (("a", pd.Series(v)), ("b", pd.Series(v * 2 + 1))):
        want = series.describe(percentiles=[0.005, 0.5, 0.999])
        names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "max": "max", "p0.005": "0.5%", "p0.5": "50%", "p0.999": "99.9%"}
        assert {n: got[column, n] for n in names} == pytest.approx({n: want[w] for n, w in names.items()})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 2499, 2501])
def test_groups_of_every_size(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    got = percentiles.exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": v})), "x", PROBS).collect()
    assert {r.p: r.value for r in got} == pytest.approx({p: np.percentile(v, p * 100) for p in PROBS})


def all_kinds():
    tiny, big = 5e-324, float(np.finfo(np.float64).max)
    rng = np.random.default_rng(4)
    own = np.concatenate([
        [0.0, -0.0, tiny, 3 * tiny, 2.2250738585072014e-308, np.nextafter(2.2250738585072014e-308, 0), big, np.inf, 1.0, np.nextafter(1, 0), np.nextafter(2, 0)],
        2.0 ** np.arange(-1074, 1024, 7), np.nextafter(2.0 ** np.arange(-1000, 1024, 11), 0),
        np.e ** (np.arange(-700, 700) / 1.024), 1 + np.arange(2000) * 2.0**-52,
        rng.integers(0, 2047 << 52, 3000).view(np.float64),
    ])
    return np.sort(np.concatenate([own, -own]))


def test_no_bin_is_out_of_order(spark):
    v = all_kinds()
    got = spark.createDataFrame(pd.DataFrame({"v": v})).selectExpr("v", f"{percentiles.MAGNITUDE} AS d1").toPandas()
    got = got.sort_values("v", kind="stable")
    assert (np.diff(got.d1.to_numpy()) >= 0).all() and got.d1.abs().max() == 10_000_000
    parts = got.groupby("d1").v.agg(["min", "max"])
    assert (parts["max"][np.isfinite(parts["max"]) & (parts["min"].abs() > 1e-300)] / parts["min"]).max() < 2


def test_values_of_every_magnitude(spark):
    v = all_kinds()
    v = v[np.isfinite(v)]
    probs = [0.0, 0.1, 0.3, 0.49, 0.5, 0.55, 0.7, 0.95, 1.0]
    got = {r.p: r.value for r in percentiles.exact_percentiles(spark.createDataFrame(pd.DataFrame({"x": v})), "x", probs).collect()}
    for p in probs:
        at = p * (len(v) - 1)
        lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
        assert got[p] == (lo if lo == hi else pytest.approx(lo + (at - np.floor(at)) * (hi - lo), rel=1e-9))


def test_infinite_values_null_groups_and_no_job_at_build_time(spark):
    v = np.concatenate([np.arange(20.0), [np.inf, np.inf, -np.inf]])
    rows = [(None, float(x)) for x in v] + [("a", 1.0), ("a", float("inf")), ("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    built = percentiles.exact_percentiles(df, "x", PROBS, ["g"])
    box = percentiles.box_summary(df.withColumn("k", df.g), ["x"], df.g, "g2")
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.g, r.p): r.value for r in built.collect()}
    finite = [p for p in PROBS if 0 < p < 0.9 and p not in (0.005, 0.01)]
    for p in finite:
        assert got[None, p] == pytest.approx(np.percentile(v, 100 * p))
    assert got[None, 0.0] == -np.inf and got[None, 1.0] == np.inf and got[None, 0.01] == -np.inf
    assert got["a", 0.0] == 1.0 and got["a", 0.5] == np.inf and {g for g, _ in got} == {None, "a"}
    assert {r.g2: r.n for r in box.collect()} == {"a": 2}


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "GROUPS", 50)
    rng = np.random.default_rng(7)
    g = np.concatenate([np.zeros(3000), rng.integers(1, 200, 4000)]).astype(int)
    frame = pd.DataFrame({"g": g, "x": rng.normal(size=len(g)).round(2)})
    df = spark.createDataFrame(frame)
    with pytest.raises(Exception, match="many_groups"):
        percentiles.exact_percentiles(df, "x", [0.5], ["g"]).collect()
    got = {(r.g, r.p): r.value for r in percentiles.exact_percentiles(df, "x", [0.1, 0.5, 0.9], ["g"], many_groups=True).collect()}
    want = frame.groupby("g").x.quantile([0.1, 0.5, 0.9])
    assert got == pytest.approx({(int(a), p): x for (a, p), x in want.items()})
    box = {r.year: r for r in percentiles.box_summary(df, ["x"], df.g, "year", many_groups=True).collect()}
    assert len(box) == frame.g.nunique() and sum(r.n for r in box.values()) == len(frame)
    q1, q3 = frame.x[frame.g == 0].quantile([0.25, 0.75])
    own = frame.x[frame.g == 0]
    far = (own < q1 - 1.5 * (q3 - q1)) | (own > q3 + 1.5 * (q3 - q1))
    assert box[0].outliers == far.sum() and box[0].low_whisker == own[~far].min()


def test_the_plan_reads_its_input_three_times(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS double) AS x")
    plan = percentiles.exact_percentiles(df, "x", PROBS, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 1000") == 3
