"""Operators 11 and 12 against brute force, and on awkward tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.llm import orchard_codes, pivot_search, vectors

CLASHING = ["id", "v", "rank", "score", "block", "code", "error", "label_error", "query_id", "part", "n"]
SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


def some_rows(seed=1, n=700, width=8, centres=12):
    """Clustered vectors, a third of them one and the same, some not whole."""
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    rows = []
    for i in range(n):
        x = middle[i % centres] + 0.2 * draw.normal(size=width) if i % 3 else middle[0]
        rows.append((i, [float(np.float32(y)) for y in x], (None, 1, 2)[i % 3] if i % 7 else 5))
    bad = [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] + [0.0] * (width - 1), None)]
    return rows + bad


def whole(rows):
    keep = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return keep, np.array([[int(np.floor(1024 * float(x))) for x in r[1]] for r in keep], np.int64)


def brute_top(rows, k=10, every=100):
    keep, m = whole(rows)
    out = []
    for i, r in enumerate(keep):
        if r[0] is None or r[0] % every:
            continue
        scores = sorted((-int(s), x[0]) for x, s in zip(keep, m @ m[i]) if x[0] is not None and x[0] != r[0])
        out += [(r[0], j + 1, v, -s) for j, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rows = some_rows()
    rows += [rows[5], rows[5], (None, rows[3][1], 1)]
    want = brute_top(rows)
    got = pivot_search.search(table(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == want
    # Many small blocks on both sides, few pivots, and fewer pivots than results.
    assert sorted(map(tuple, pivot_search.search(table(spark, rows), block=50, queries=2, n_pivots=12).collect())) == want
    assert sorted(map(tuple, pivot_search.search(table(spark, rows), block=90, n_pivots=3).collect())) == want


def test_top_k_of_small_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (100, [1.0, 0.0], 2), (None, [9.0, 9.0], 1)]
    got = sorted(map(tuple, pivot_search.search(table(spark, rows)).collect()))
    assert got == [(0, 1, 100, 1 << 20), (0, 2, 1, 1 << 19), (100, 1, 0, 1 << 20), (100, 2, 1, 1 << 19)]
    for few in ([], [(0, None, 1)], [(7, [1.0], 1)], [(0, [1.0], 1)]):
        assert pivot_search.search(table(spark, few)).count() == 0
    # A shorter vector ends in zeros; an empty one scores 0.
    odd = [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [], 1)]
    assert sorted(map(tuple, pivot_search.search(table(spark, odd)).collect())) == [(0, 1, 1, 1 << 20), (0, 2, 2, 0)]


def test_bounds_hold_and_stop_the_search():
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(20, 16)) * 900
    rows = np.floor(np.repeat(middle, 100, axis=0) + 30 * draw.normal(size=(2000, 16)))
    ids, pivots = np.arange(2000), rows[::40]
    far = pivot_search.distances(rows, pivots)
    bounds = pivot_search.upper_bounds(rows[:5], rows, far[:5], far)
    assert (bounds >= rows[:5] @ rows.T).all()
    for i in range(5):
        start = pivot_search.kth_best(rows[i] @ pivots.T, 10)
        best, scores, seen = pivot_search.best_of(rows[i], ids, rows, bounds[i], start, 10)
        want = np.lexsort((ids, -(rows @ rows[i])))[:10]
        assert (best == want).all() and seen < 1000


def test_search_has_no_side_that_spark_could_broadcast(spark):
    # Spark takes a side's size from before its blocks are repeated for those of the other.
    plan = pivot_search.search(table(spark, some_rows()), block=50, queries=2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_top_k_over_many_shares_and_parts(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "PART", 1)
    monkeypatch.setattr(pivot_search, "SHARE", 1)
    rows = some_rows()
    rows += [rows[100], rows[100], (200, rows[4][1], 1), (None, rows[3][1], 1)]
    assert pivot_search._grid(len(rows), 10, 20, 2) == (36, 5)
    got = pivot_search.search(table(spark, rows), block=20, queries=2)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_grid_follows_the_table():
    for n in (1, 50_000, 600_000, 2_500_000, 15_000_000, 75_000_000):
        asked = -(-n // 100)
        shares, parts = pivot_search._grid(n, asked, pivot_search.BLOCK, pivot_search.QUERIES)
        assert asked <= parts * pivot_search.PART * pivot_search.QUERIES
        # Queries go to each share of the table; with the rows they give they are no more than the table is.
        assert shares == 1 or shares * asked * pivot_search.QUERY_COST <= parts * n
        assert shares * parts <= 12 + n / 10_000


@pytest.mark.parametrize(
    ("centres", "spread", "size", "ways"),
    [(1, 1.0, 900, {"product"}), (150, 0.01, 900, {"product", "ordered"}), (1, 1.0, 2.0**20, {"product"})],
)
def test_both_ways_of_evaluation(monkeypatch, centres, spread, size, ways):
    seen = set()
    for way in ("product", "ordered"):
        f = getattr(pivot_search.Cell, way)
        monkeypatch.setattr(pivot_search.Cell, way, lambda *a, f=f, way=way: (seen.add(way), f(*a)))
    draw = np.random.default_rng(6)
    middle = draw.normal(size=(centres, 8))
    rows = np.floor(size * (middle[np.arange(6000) % centres] + spread * draw.normal(size=(6000, 8)))).astype(np.int32)
    rows = np.clip(rows, 1 - vectors.MOST, vectors.MOST - 1)
    ids = np.arange(6000) // 2
    cell = pivot_search.Cell(ids[:200], rows[:200], ids[::47], rows[::47].astype(np.float64), 10, 64)
    for i in range(0, 6000, 700):
        cell.meet(ids[i : i + 700], rows[i : i + 700])
    assert seen == ways
    for i in range(200):
        scores = rows.astype(np.int64) @ rows[i].astype(np.int64)
        want = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:10]
        assert (cell.best_ids[i] == ids[want]).all() and (cell.best[i] == scores[want]).all()


def brute_codes(rows, parts=4, entries=256, rounds=4):
    keep, m = whole(rows)
    order = sorted(range(len(keep)), key=lambda i: (keep[i][0] is None, keep[i][0] or 0, m[i].tolist()))
    cut = np.split(m, parts, axis=1)
    books = [c[order[:entries]].copy() for c in cut]

    def near(p):
        d = ((cut[p][:, None, :] - books[p][None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = near(p)
            for e in set(at.tolist()):
                books[p][e] = cut[p][at == e].sum(axis=0) // (at == e).sum()
    codes, errors = zip(*(near(p) for p in range(parts)))
    error = np.sum(errors, axis=0)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    label = {}
    for r, e in zip(keep, error.tolist()):
        label[r[2]] = label.get(r[2], 0) + e
    return sorted(
        (r[0] if r[0] is not None else -1, "".join(f"{c[i]:02x}" for c in codes), int(error[i]), label[r[2]], digest)
        for i, r in enumerate(keep)
    )


def coded(df, **settings):
    out = orchard_codes.encode(df, **settings)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r) for r in out.na.fill(-1, ["vec_id"]).collect())


def test_codes_equal_brute_force(spark):
    rows = some_rows(2)
    rows += [rows[4], rows[4], (None, rows[8][1], 1), (900, [], 1)]
    plain = [r for r in rows if r[1] != []]
    assert coded(table(spark, rows)) == brute_codes(plain)
    assert coded(table(spark, rows), parts=2, entries=16, rounds=2) == brute_codes(plain, 2, 16, 2)
    few = some_rows(4, n=30)
    assert coded(table(spark, few)) == brute_codes(few)


def test_codes_of_awkward_tables(spark):
    assert orchard_codes.encode(table(spark, [])).count() == 0
    assert orchard_codes.encode(table(spark, [(1, None, 1)])).count() == 0
    same = [(i, [0.5] * 4, None) for i in range(20)]
    assert coded(table(spark, same)) == [(i, "00000000", 0, 0, brute_codes(same)[0][4]) for i in range(20)]
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)]):
        with pytest.raises(ValueError, match="one length"):
            orchard_codes.encode(table(spark, rows))


def test_orchard_prunes_and_breaks_ties_low():
    draw = np.random.default_rng(5)
    entries = np.floor(draw.normal(size=(256, 4)) * 1000).astype(np.int64)
    entries[200] = entries[10]
    book = orchard_codes.Book.of(entries)
    points = entries[draw.integers(0, 256, 500)] + draw.integers(-30, 30, (500, 4))
    points = np.concatenate([points, entries[200][None]])
    entry, best, looked = book.nearest(points)
    d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and entry[-1] == 10
    assert looked < 0.5 * d.size


def test_components_too_large_are_refused(spark):
    df = table(spark, [(0, [2.0**20, 1.0], 1), (1, [0.0, 1.0], 1)])
    with pytest.raises(Exception, match="after scaling"):
        vectors.kept(df, "vec_id", "embedding").collect()
    kept = vectors.kept(df.where("vec_id = 1"), "vec_id", "embedding", F.col("label")).collect()
    assert [tuple(r) for r in kept] == [(1, [0, 1024], 1)]
