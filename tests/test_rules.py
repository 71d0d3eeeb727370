"""Cleaning rules, physics constants, model outputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield import schema
from lagfield.catalog.models import small_network
from lagfield.functions import geometry as G
from lagfield.functions import thermal as H
from lagfield.functions import transforms as M
from lagfield.operators import cleaning as V
from lagfield.operators import keyed
from lagfield.operators import statistics as S
from lagfield.plans import baselines, scoring


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_feature_layout():
    cols = schema.feature_columns()
    assert len(cols) == 189 and cols[8] == "AL_index_0" and cols[39] == "SYM_H_0"
    assert cols[-5:] == ["f107_index_0", "f107_index_1", "f107_index_2", "f107_index_3", "Kp_index"]
    assert len(schema.feature_schema()) == 191


def test_reference_temperatures(spark):
    te = lambda ilat, h: H.temperature_at(F.lit(h), F.lit(2000.0), F.lit(4.0), F.lit(ilat))
    a, b = one(spark, te(25.0, 1500.0), te(55.0, 2000.0))
    assert a == pytest.approx(3552.649269735, abs=1e-8) and b == pytest.approx(3865.973183010, abs=1e-8)


def test_grid_latitude(spark):
    assert one(spark, G.grid_latitude(F.lit(1000.0)))[0] == pytest.approx(40.4897175, abs=1e-6)


def test_edges_of_geometry(spark):
    pole, half, far, zero = one(
        spark,
        G.l_shell(F.lit(90.0)),
        G.l_shell(F.lit(60.0)),
        G.magnetic_local_time(F.lit(-190.0)),
        H.gradient_factor(F.lit(0.0), F.lit(2.0)),
    )
    assert pole is None and half == pytest.approx(4.0) and zero is None
    assert far == pytest.approx((-190 / 15 + 12) % 24)


def test_null_and_nan_in_filters(spark):
    df = spark.createDataFrame([(1.0, None), (999.0, 1.0), (None, 999.0), (2.0, 3.0)], "a double, b double")
    assert V.drop_sentinel_rows(df, ["a", "b"]).count() == 2
    nan = spark.createDataFrame([(float("nan"),), (1500.0,)], "x double")
    assert V.nan_to_null(nan).where("x >= 1000").count() == 1
    assert nan.where(V.finite("x")).count() == 1


def test_schema_checks(spark):
    df = spark.range(1).selectExpr("id", "1.0D AS x")
    with pytest.raises(ValueError):
        V.require_columns(df, ["id", "y"])
    with pytest.raises(ValueError):
        V.require_columns(df, ["id"], exact=True)
    with pytest.raises(TypeError):
        V.require_types(df, {"x": T.TimestampNTZType})
    with pytest.raises(ValueError):
        V.in_days("x", "1991-13-01", "1991-01-02")


def test_missing_data_policy(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (3.0,)], "x double")
    with pytest.raises(ValueError):
        V.guard_missing(df, ["x"], 5.0)
    assert V.guard_missing(df, ["x"], 25.0).count() == 3


def test_duplicate_cells_and_scores_fail(spark):
    twice = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0)], "r int, c string, v double")
    with pytest.raises(Exception):
        keyed.pivot_cells(twice, "r", "c", "v", ["a"]).collect()
    for ids in (2, 3):  # one id missing, one id doubled
        scored = spark.range(ids).unionByName(spark.range(ids - 2)).selectExpr("id", "1 AS s")
        with pytest.raises(Exception):
            keyed.attach_by_key(spark.range(3), scored, ["id"]).collect()


def test_zero_truth_counts_as_outside(spark):
    df = spark.createDataFrame([(0.0, 1.0), (100.0, 101.0), (100.0, float("nan"))], "t double, p double")
    got = S.accuracy_report(df, "t", "p").first()
    assert (got.n, got.within_5_percent, got.within_100) == (2, 50.0, 100.0)


def test_class_outputs(spark):
    z = [0.5, 3.0, 3.0, -1.0]
    df = spark.createDataFrame([(z, 2)], "z array<double>, label int")
    row = scoring.class_outputs(df, "z").withColumn("loss", M.cross_entropy("z", "label")).first()
    p = np.exp(z) / np.exp(z).sum()
    assert row.predicted_class == 1 and row.predicted == 150
    assert row.confidence == pytest.approx(100 * p.max())
    assert row.entropy == pytest.approx(-(p * np.log(p + 1e-10)).sum())
    assert row.loss == pytest.approx(-math.log(p[2]))
    assert sum(df.select(M.softmax("z")).first()[0]) == pytest.approx(1.0)


def test_target_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(-5.0,), (0.0,), (99.9,), (100.0,), (99999.0,)], "x double").select(M.target_class("x")).collect()]
    assert got == [0, 0, 0, 1, 149]


def test_zero_std_leaves_values(spark):
    df = spark.createDataFrame([(3.0, [1.0, None])], "Kp_index double, AL_index array<double>")
    out = scoring.preprocess(df, {"AL_index": 5.0}, {"AL_index": 0.0}, ["Kp_index", "AL_index"]).first()
    assert out.AL_index == [1.0, 0.0] and out.Kp_index == pytest.approx(3 / 45 - 1)


def test_wide_and_array_preprocessing_agree(spark):
    means, stds = {"SYM_H": 2.0}, {"SYM_H": 4.0}
    wide = spark.createDataFrame([(1.0, None)], "SYM_H_0 double, SYM_H_1 double")
    got = scoring.preprocess(wide, means, stds, ["SYM_H_0", "SYM_H_1"]).first()
    packed = scoring.preprocess(wide.selectExpr("array(SYM_H_0, SYM_H_1) AS SYM_H"), means, stds, ["SYM_H"]).first()
    assert list(got) == packed.SYM_H == [-0.25, 0.0]


def test_gradient_fit_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(float(lat), (900 + 40 * np.arange(17) + rng.normal(0, 30, 17)).tolist()) for lat in range(5, 80, 9)]
    df = spark.createDataFrame([*rows, (45.0, None)], "ILAT double, profile array<double>")
    got = {r.ILAT: r.g for r in df.where("profile IS NOT NULL").select("ILAT", baselines.fit_gradient("profile", "ILAT").alias("g")).collect()}
    r0, h = 1 + 400 / 6371, np.arange(400, 2001, 100)
    for lat, y in rows:
        shell = 1 / math.cos(math.radians(lat)) ** 2
        top = (shell - 1) * 6371
        ell = np.log10(h / 400)
        b = 0.05 / (2 * shell - r0) * (88 + ell * (10.5 - ell))
        c = b * ((top - 400) / r0**2 - (top - h) / (1 + h / 6371) ** 2)
        grid = np.linspace(-20, 50, 701)
        with np.errstate(invalid="ignore"):
            sse = [np.sum((np.array(y) - y[0] * (1 + g / y[0] * c) ** (2 / 7)) ** 2) for g in grid]
        assert got[lat] == pytest.approx(round(grid[int(np.nanargmin(sse))], 1))
    assert df.where("profile IS NULL").select(baselines.fit_gradient("profile", "ILAT")).first()[0] is None


def every_candidate(y, c):
    """Place of the first least finite error among all candidates, or -1."""
    grid = np.linspace(-20, 50, 701)
    with np.errstate(all="ignore"):
        x = grid[None, :] / y[:, :1]
        error = sum((y[:, k, None] - y[:, :1] * (1.0 + x * c[:, k, None]) ** (2.0 / 7.0)) ** 2 for k in range(y.shape[1]))
    error = np.where(np.isfinite(error), error, np.inf)
    return np.where(np.isfinite(error).any(axis=1), error.argmin(axis=1), -1)


def test_candidates_left_out_are_never_the_best():
    rng = np.random.default_rng(3)
    n, k = 600, np.arange(17)
    y = np.concatenate([
        rng.uniform(700, 3000, (n, 1)) + k * rng.uniform(-40, 150, (n, 1)) + rng.normal(0, 20, (n, 17)),
        rng.uniform(-4000, 4000, (n, 17)),  # no curve fits, errors may have several minima
        rng.choice([0.0, 1e-300, 1e300, 5.0], (n, 17)),
    ])
    c = np.cumsum(rng.uniform(0, 300, (3 * n, 17)), axis=1) * rng.choice([1, 1, 1, 0, -1], (3 * n, 1))
    c[:, 0] = 0
    got = baselines.best_candidates(y, c)
    assert (got == every_candidate(y, c)).all() and (got == -1).any() and len(set(got)) > 100
    # Profiles on the curve of one candidate, each of them in turn, those at the ends and beside tried ones too.
    c = np.repeat(c[:1], 701, axis=0)
    y = 2000 * (1 + np.linspace(-20, 50, 701)[:, None] / 2000 * np.minimum(c, 90)) ** (2 / 7)
    assert (baselines.best_candidates(y, np.minimum(c, 90)) == np.arange(701)).all()


def test_profiles_without_a_fit_and_of_several_lengths(spark):
    y = [900 + 40.0 * k for k in range(17)]
    odd = [None, [], [None, *y[1:]], [*y[:16], None], [float("nan"), *y[1:]], [0.0, *y[1:]], [float("inf"), *y[1:]]]
    df = spark.createDataFrame([(45.0, p) for p in odd], "ILAT double, profile array<double>")
    assert {r[0] for r in df.select(baselines.fit_gradient("profile", "ILAT")).collect()} == {None}
    df = spark.createDataFrame([(45.0, y), (45.0, y[:9]), (90.0, y), (None, y)], "ILAT double, profile array<double>").coalesce(1)
    whole, short, *none = [r[0] for r in df.select(baselines.fit_gradient("profile", "ILAT")).collect()]
    assert whole is not None and short is not None and none == [None, None]


def test_fits_are_dealt_to_all_cores(spark):
    rows = spark.range(64).coalesce(1).selectExpr(
        "id", "45D AS ILAT", "2000D AS Altitude", "transform(sequence(0, 16), k -> 900D + k * (id % 50)) AS profile"
    )
    fitted = baselines.fitted_model(rows).withColumn("task", F.spark_partition_id())
    got = fitted.collect()
    assert sorted(r.id for r in got) == list(range(64)) and fitted.columns[:3] == ["id", "ILAT", "Altitude"]
    assert len({r.task for r in got}) >= spark.sparkContext.defaultParallelism


def test_network_scoring_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    net = small_network()
    got, single = (
        {r.id: r for r in scoring.score_network(df, "x", net, with_scores=True, precision=p, slice_rows=7).collect()}
        for p in ("float64", "float32")
    )
    w, b = np.array(net[0]["weight"]), np.array(net[0]["bias"])
    h = x @ w.T + b
    h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
    h = np.maximum(h * net[0]["gamma"] + net[0]["beta"], 0)
    z = h @ np.array(net[1]["weight"]).T + net[1]["bias"]
    for i in range(40):
        assert np.allclose(got[i].scores, z[i]) and got[i].predicted_class == z[i].argmax()
        assert np.allclose(single[i].scores, z[i], rtol=1e-4, atol=1e-4)


def test_rows_without_features_have_no_class(spark):
    net = small_network()
    n = len(net[0]["weight"][0])
    rows = [(0, [0.5] * n), (1, None), (2, [0.5] * (n - 1) + [None]), (3, [float("nan")] * n)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r.id: tuple(r)[1:] for r in scoring.score_network(df, "x", net, with_scores=True).collect()}
    assert all(v is not None for v in got[0]) and all(got[i] == (None,) * 5 for i in (1, 2, 3))
    with pytest.raises(ValueError, match="most_bytes"):
        scoring.score_network(df, "x", net, most_bytes=1000)


def test_logistic_family_learns(spark):
    rows = [(float(i % 3) + (i % 7) / 100, float(i % 3) * 100 + 10) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, te double")
    model = scoring.fit_classes(df, ["x"], "te", classes=3, family="logistic", iterations=50)
    out = scoring.score_classes(model, df)
    assert out.where("predicted_class * 100 + 10 = te").count() > 250


def test_placeholders_in_columns_and_lag_arrays(spark):
    df = spark.createDataFrame(
        [(999.9, [1.0, 9.999, None], 9999, "999.9"), (5.0, [9.999], 1, "x")], "a double, lag array<double>, k long, s string"
    )
    assert {r.value: r.hits for r in V.count_invalid(df).collect()} == {999.9: 1, 9.999: 2, 9999.0: 1}
    out = V.replace_invalid(df)
    assert [tuple(r) for r in out.collect()] == [(0.0, [1.0, 0.0, None], 0, "999.9"), (5.0, [0.0], 1, "x")]
    assert out.schema == df.schema


def test_null_counts_see_nan(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (None, None)], "x double, s string")
    got = {r.column: (r.nulls, r.non_nulls) for r in V.null_counts(df).collect()}
    assert got == {"x": (2, 1), "s": (2, 1)}


def test_missing_values_have_no_class_and_no_place(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (250.0,), (-5.0,), (1e9,)], "x double")
    assert [r[0] for r in df.select(M.target_class("x")).collect()] == [None, None, 2, 0, 149]
    none = F.lit(None).cast("double")
    place = G.dipole_position(none, F.lit(4.0), F.lit(10.0))
    assert one(spark, G.grid_latitude(none), place["mag_lat_rad"], place["x_sm"]) == (None, None, None)


def test_training_refuses_rows_without_a_target(spark):
    df = spark.createDataFrame([(1.0, 100.0), (2.0, None)] * 10, "a double, Te1 double")
    with pytest.raises(Exception, match="has no Te1"):
        scoring.fit_classes(df, ["a"], "Te1", classes=3, family="logistic")
    model = scoring.fit_classes(df.where("Te1 IS NOT NULL"), ["a"], "Te1", classes=3, family="logistic")
    with pytest.raises(Exception):
        scoring.score_classes(model, df.withColumn("a", F.lit(None).cast("double"))).collect()
    assert scoring.score_classes(model, df).count() == 20


def test_placeholders_keep_each_type(spark):
    df = spark.sql(
        "SELECT 9007199254740993 AS big, 9999 AS hit, CAST(999.9 AS decimal(6,1)) AS d, CAST(12.5 AS decimal(6,1)) AS e,"
        " CAST(999.9 AS float) AS f, CAST(7 AS tinyint) AS t"
    )
    out = V.replace_invalid(df, [999.9, 9999.0])
    assert out.dtypes == df.dtypes
    assert tuple(map(float, out.first())) == (9007199254740993.0, 0.0, 0.0, 12.5, 0.0, 7.0) and out.first().big == 9007199254740993


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1)] + [(1.0, 1)] * 9, "x double, y int")
    with pytest.raises(ValueError):
        V.guard_missing(df, ["x", "y"], 5.0)
    assert V.guard_missing(df, ["x", "y"], 20.0).count() == 9


def test_the_null_key_is_computed_too(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "k int, v string")
    got = keyed.per_distinct(df, "k", {"w": F.coalesce(F.col("k") * 10, F.lit(-1))})
    assert sorted((r.v, r.w) for r in got.collect()) == [("a", 10), ("b", -1), ("c", -1), ("d", 10)]


def test_every_statistic_reaches_the_caller(spark):
    from lagfield.sources.writers import stats_as_maps

    stats = spark.range(1500).selectExpr("concat('c', id) AS name", "id * 1D AS mean", "1D AS std")
    means, stds = stats_as_maps(stats)
    assert len(means) == len(stds) == 1500


def test_moments_of_chunks_merge_in_any_order(spark, tmp_path):
    import numpy as np

    from lagfield.operators import statistics as S
    from lagfield.sources import writers

    rng = np.random.default_rng(3)
    v = np.concatenate([1e9 + rng.normal(size=500), rng.normal(size=300), [np.nan] * 4])
    rng.shuffle(v)
    rows = [(float(x), [float(x), None, 2.0], i % 7) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "x double, a array<double>, c int")
    groups = {"x": ["x"], "both": ["x", "a"], "none": ["n"]}
    df = df.withColumn("n", F.lit(None).cast("double"))
    whole = {r.name: (r.mean, r.std) for r in S.stats_of(S.moments(df, groups)).collect()}
    path = str(tmp_path / "moments")
    for c in (3, 0, 6, 1, 5, 2, 4, 0):
        writers.write_moments(df.where(F.col("c") == c), groups, path, str(c))
    got = {r.name: (r.mean, r.std) for r in writers.read_moments(spark, path).collect()}
    good = v[~np.isnan(v)]
    assert set(got) == set(whole) == {"x", "both"}
    assert got["x"] == pytest.approx((good.mean(), good.std()), rel=1e-12)
    assert got["both"] == pytest.approx(whole["both"], rel=1e-12)
    sample = {r.name: r.std for r in writers.read_moments(spark, path, sample=True).collect()}
    assert sample["x"] == pytest.approx(good.std(ddof=1), rel=1e-12)


def test_dense_cells_have_their_places(spark):
    from lagfield.operators.keyed import pivot_dense

    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 3, None), ("a", 4, 2.0), ("b", 2, 5.0), (None, 4, 6.0)], "r string, p int, v double")
    got = {r.r: r.cells for r in pivot_dense(cells, "r", F.col("p"), "v", 5).collect()}
    assert got == {"a": [1.0, None, None, None, 2.0], "b": [None, None, 5.0, None, None], None: [None] * 4 + [6.0]}
    for bad in (("a", 3, 9.0), ("b", 5, 1.0), ("b", -1, 1.0)):
        more = cells.union(spark.createDataFrame([bad], cells.schema))
        with pytest.raises(Exception, match="cell"):
            pivot_dense(more, "r", F.col("p"), "v", 5).collect()
    # A grid as large as the published one: the plan does not grow with its columns.
    times, heights = 1872, 701
    grid = spark.range(times * heights).selectExpr(f"id % {times} AS t", f"id div {times} AS h", "CAST(id AS double) AS v")
    dense = pivot_dense(grid, "h", F.col("t"), "v", times)
    assert len(dense._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    out = dense.agg(F.count("*"), F.sum(F.size("cells")), F.sum(F.expr("aggregate(cells, 0D, (a, x) -> a + x)"))).first()
    assert tuple(out) == (heights, times * heights, float(times * heights * (times * heights - 1) // 2))
