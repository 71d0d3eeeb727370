import hashlib

import pytest
from pyspark.sql import functions as F

from lagfield.operators import sampling as P


@pytest.fixture(scope="module")
def frame(spark):
    # One group holds nearly all rows.
    return spark.range(20_000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("grp")
    )


def order(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 777, 19_999, 20_000, 25_000])
def test_split_is_exact_disjoint_and_whole(frame, n):
    test, train = P.split_exact(frame, "key", n)
    a, b = {r.key for r in test.collect()}, {r.key for r in train.collect()}
    assert len(a) == min(n, 20_000) and len(a) + len(b) == 20_000 and not a & b
    assert a == set(order(range(20_000))[:n])


def test_sample_keeps_small_tables_whole(frame):
    assert P.sample_at_most(frame, "key", None).count() == 20_000
    assert P.sample_at_most(frame, "key", 30_000).count() == 20_000


def test_ranks_follow_the_hash_within_groups(frame):
    got = P.ranked(frame, "key", ["grp"]).collect()
    for grp in ("rare", "hot"):
        ranks = {r.key: r["rank"] for r in got if r.grp == grp}
        assert [ranks[k] for k in order(ranks)] == list(range(1, len(ranks) + 1))


def test_mixture_ratios_are_checked(frame):
    rare = frame.where("grp = 'rare'")
    with pytest.raises(ValueError):
        P.mixture([("a", rare)], "key", [0.5, 0.5])
    with pytest.raises(ValueError):
        P.mixture([("a", rare), ("b", rare)], "key", [0.5, 0.6])


def test_mixture_draws_by_ratio_with_replacement(frame):
    parts = [(g, frame.where(F.col("grp") == g)) for g in ("rare", "hot")]
    got = P.mixture(parts, "key", [0.7, 0.3], draws=8000)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert sum(counts.values()) == 8000 and abs(counts["rare"] / 8000 - 0.7) < 0.03
    assert got.where("source = 'rare'").select("key").distinct().count() <= 400


def test_null_and_doubled_keys_are_refused(spark):
    nulls = spark.range(20).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("key"))
    for job in (lambda: P.split_exact(nulls, "key", 3)[0].collect(), lambda: P.ranked(nulls, "key").collect()):
        with pytest.raises(Exception, match="null"):
            job()
    doubled = spark.range(20).select((F.col("id") % 2).alias("key"))
    with pytest.raises(ValueError, match="unique"):
        P.split_exact(doubled, "key", 3)
    assert P.split_exact(doubled, "key", 10)[0].count() == 10


def test_null_groups_are_ranked(spark):
    rows = spark.range(30).select(F.col("id").alias("key"), F.when(F.col("id") > 9, "a").alias("grp"))
    got = P.ranked(rows, "key", ["grp"]).collect()
    assert sorted(r["rank"] for r in got if r.grp is None) == list(range(1, 11)) and len(got) == 30


def test_drawing_from_nothing_is_refused(frame):
    with pytest.raises(ValueError, match="nothing to draw"):
        P.mixture([("a", frame), ("b", frame.where("key < 0"))], "key", [0.5, 0.5], draws=100)


def test_doubled_keys_have_one_order_and_spread(spark):
    rows = [(i % 3 and i, "g" if i % 2 else None, i // 7) for i in range(600)]
    df = spark.createDataFrame(rows, "key int, grp string, x int")
    want = {}
    for grp in (None, "g"):
        own = sorted((r for r in rows if r[1] == grp), key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0], r[2]))
        want[grp] = own
    for frame in (df.coalesce(1), df.repartition(5)):
        got = P.ranked(frame, "key", ["grp"]).collect()
        for grp, own in want.items():
            mine = sorted((r for r in got if r.grp == grp), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, len(own) + 1))
            assert [(r.key, r.grp, r.x) for r in mine] == own
    same = spark.range(4000).selectExpr("1 AS key", "map('a', 1) AS m").repartition(4)
    numbered = P.ranked(same, "key")
    assert sorted(r["rank"] for r in numbered.collect()) == list(range(1, 4001))
    # Equal rows lie in several files, one a range.
    assert numbered.select(F.input_file_name()).distinct().count() > 1
    assert P.ranked(same.where("key > 1"), "key").count() == 0
