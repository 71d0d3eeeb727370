"""Exact percentiles by radix selection, in three lazy aggregates and without a group in one task.

Values are told apart in three steps, each finer and none out of order. One aggregate counts the rows of
every group by the magnitude of their values (a thousand bins to a factor of e, some 3 million for
all doubles); running counts over these bins tell in which one each wanted rank lies. The second
aggregate cuts those bins into 2^21 even parts, the third counts the values of the parts that
are left, at most 2^22 different ones. So a percentile costs three scans of one column whatever its values
are, nothing is written or run when the plan is built, and what is shuffled are counts: a value that a
third of all rows share is one number a task. Windows run over counted bins only.

Rows meet the bins of their group by a broadcast of a few rows a group. That is for up to
``GROUPS`` groups, which the plan itself checks; with ``many_groups`` the two are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bins to a factor of e, and even parts of a bin.
FINENESS = 1024
PARTS = 1 << 21
# Most groups whose bins are broadcast.
GROUPS = 10_000
#: The bin of a value: none is out of order, since a computed logarithm never falls as its argument grows.
MAGNITUDE = (
    "CASE WHEN v = 0 THEN 0 WHEN v = double('inf') THEN 10000000 WHEN v = -double('inf') THEN -10000000"
    f" ELSE CAST(signum(v) AS int) * (CAST(floor((ln(abs(v)) + 746) * {FINENESS}) AS int) + 1) END"
)
#: The part of its bin, from ``lo`` to ``hi``, that a value lies in; a bin is so narrow that v - lo is exact.
PART = f"CASE WHEN lo < hi THEN CAST(floor((v - lo) / (hi - lo) * {PARTS}) AS int) ELSE 0 END"


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the key columns of the left stay."""
    if not keys:
        return left.crossJoin(right)  # one row on the right
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    cond = F.expr(" AND ".join(f"`{c}` <=> `_r_{c}`" for c in keys))
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    data = df.select(*by, F.col(value).cast("double").alias("v"))
    return data.where("v IS NOT NULL AND NOT isnan(v)")


def _hits(counts: DataFrame, group: Sequence[str], digit: str, kept: Sequence[str]) -> DataFrame:
    """The bins that hold wanted ranks: (kept…, n, wanted), ranks now counted from the bin's first row.

    ``counts`` are (group…, digit, c, n, wanted, …); n and wanted depend on the group alone.
    """
    before = W.partitionBy(*group).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)
    bins = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    inside = "filter(wanted, t -> t.k >= start AND t.k < start + c)"
    moved = "transform(own, t -> named_struct('p', t.p, 'upper', t.upper, 'k', t.k - start)) AS wanted"
    found = bins.selectExpr(*kept, "n", "start", f"{inside} AS own").where("size(own) > 0")
    return found.selectExpr(*kept, "n", moved)


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), many_groups: bool = False
) -> DataFrame:
    """(by…, p, value): percentiles with linear interpolation between order statistics.

    Nulls and NaN are left out, infinite values are values (between minus infinity and a larger one lies
    minus infinity, between a smaller one and infinity infinity); null group keys are a group of their
    own; a group without values has no row. More than ``GROUPS`` groups are an error unless
    ``many_groups`` is set. ``by`` columns must not be called v, d1, d2, lo, hi, c, n or wanted.
    """
    by, probs = list(by), sorted({float(p) for p in probs})
    binned = _values(df, value, by).selectExpr(*by, "v", f"{MAGNITUDE} AS d1")
    ends = [F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    counts = binned.groupBy(*by, "d1").agg(*ends).withColumn("n", F.sum("c").over(W.partitionBy(*by)))
    ranks = ", ".join(
        f"named_struct('p', {p!r}D, 'upper', {u}, 'k', CAST({f}({p!r}D * (n - 1)) AS bigint))"
        for p in probs
        for u, f in (("false", "floor"), ("true", "ceil"))
    )
    hits = _hits(counts.selectExpr("*", f"array({ranks}) AS wanted"), by, "d1", [*by, "d1", "lo", "hi"])
    few = not by or not many_groups
    if few:
        hits = _at_most(hits, 2 * len(probs) * GROUPS)

    inner = [*by, "d1"]
    rows = _joined(binned, F.broadcast(hits) if few else hits, inner).selectExpr(*inner, f"{PART} AS d2", "v", "n", "wanted")
    counts = rows.groupBy(*inner, "d2", "n", "wanted").agg(*ends)
    hits = _hits(counts, inner, "d2", [*inner, "d2", "lo", "hi"])

    rows = _joined(binned, F.broadcast(hits) if few else hits, inner).where("v BETWEEN lo AND hi")
    counts = rows.groupBy(*inner, "d2", "v", "n", "wanted").agg(F.count("*").alias("c"))
    hits = _hits(counts, [*inner, "d2"], "v", [*by, "v"])

    found = hits.selectExpr(*by, "v", "n", "inline(wanted)").groupBy(*by, "p", "n")
    sides = found.agg(F.max(F.expr("IF(upper, NULL, v)")).alias("lo"), F.max(F.expr("IF(upper, v, NULL)")).alias("hi"))
    share = "(p * (n - 1) - floor(p * (n - 1)))"
    return sides.selectExpr(
        *by, "p", f"CASE WHEN lo = hi OR {share} = 0 OR lo = -double('inf') THEN lo ELSE lo + {share} * (hi - lo) END AS value"
    )


def _at_most(hits: DataFrame, most: int) -> DataFrame:
    """``hits``, failing where there are more than ``most`` rows; no task sees more than one row beyond that."""
    refused = F.raise_error(F.lit(f"more than {GROUPS} groups: set many_groups")).cast("bigint")
    checked = F.when(F.count("*").over(W.partitionBy()) <= most, F.col("n")).otherwise(refused)
    return hits.limit(most + 1).withColumn("n", checked)


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value) rows, one scan; a column goes by its place in ``columns``, missing values are left out."""
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(*by, F.posexplode(cells).alias("column", "value")).where("value IS NOT NULL AND NOT isnan(value)")


def named(columns: Sequence[str]) -> Column:
    """The name of the column that ``melt`` numbered."""
    return F.get(F.array(*map(F.lit, columns)), F.col("column"))


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, statistic, value): count, mean, sample std, min, percentiles, max."""
    plain = {"count": "count({})", "mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "max": "max({})"}
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = f"nanvl(CAST(`{c}` AS double), NULL)"
        aggs += [F.expr(e.format(x)).alias(f"{n}{i}") for n, e in plain.items()]
        rows += [f"struct('{c}' AS `column`, '{n}' AS statistic, CAST({n}{i} AS double) AS value)" for n in plain]
    base = df.agg(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")
    present = base.where("value IS NOT NULL AND NOT (statistic = 'count' AND value = 0) OR statistic = 'std'")
    points = exact_percentiles(melt(df, columns), "value", probs, ["column"]).select(
        named(columns).alias("column"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("statistic"), "value"
    )
    return present.unionByName(points)


def box_summary(
    df: DataFrame, columns: Sequence[str], bucket: Column, name: str = "bucket", many_groups: bool = False
) -> DataFrame:
    """(column, bucket, n, q1, median, q3, low_whisker, high_whisker, outliers).

    Whiskers reach the furthest value within 1.5 interquartile ranges of the box.
    """
    tagged = df.withColumn(name, bucket).where(F.col(name).isNotNull())
    long, by = melt(tagged, columns, [name]), ["column", name]
    q = exact_percentiles(long, "value", [0.25, 0.5, 0.75], by, many_groups)
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    box = q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(c) for c, p in quarters.items()])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fits = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    boxed = _joined(long, box if many_groups else F.broadcast(box), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.max(c).alias(c) for c in quarters),
        F.min(F.when(fits, F.col("value"))).alias("low_whisker"),
        F.max(F.when(fits, F.col("value"))).alias("high_whisker"),
        F.count_if(~fits).alias("outliers"),
    )
    return boxed.withColumn("column", named(columns))
