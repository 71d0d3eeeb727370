"""Reproducible sampling by hashed keys.

A row's position in the random order is the md5 of ``seed|key``. The order depends
on nothing but the key, so a lost task recomputes the same sample, and any SQL
engine can reproduce it. A null key is an error, and so is a doubled key where it would
make an exact size inexact; elsewhere rows of one key follow each other by their columns.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.operators.bounded import settle

PREFIX = 3  # hex digits: 4096 slices of the hash space


def hash_order(key, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    refused = F.raise_error(F.lit("a sampling key is null")).cast("string")
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), refused)))


def _first_unit(hash_hex: Column, start: int = 1) -> Column:
    """Eight hex digits as a uniform number in [0, 1)."""
    part = F.conv(F.substring(hash_hex, start, 8), 16, 10).cast("double")
    return part / F.lit(4294967296.0)


def _slice_counts(df: DataFrame, slices: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Rows per (by, hash slice) with the running total before each slice.

    Counting combines before the shuffle; the running window sees one row per slice
    and ``by`` value.
    """
    counts = df.groupBy(*by, F.concat(*slices).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    run = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_c").over(run), F.lit(0)))


def cut_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> str | None:
    """The n-th smallest hash (None when there are fewer rows): a radix selection.

    Level one finds the slice holding rank n, level two the slice inside it, and
    only that remainder — about one row in sixteen million — is ordered. Nothing
    but one row per level reaches the driver.
    """
    hashed = df.select(hash_order(key, seed).alias("h"))
    if n <= 0:
        return ""
    rank, scope = n, hashed
    for level in range(2):
        part = F.substring("h", 1 + level * PREFIX, PREFIX)
        found = (
            _slice_counts(scope, [part], [])
            .where((F.col("_before") < rank) & (F.col("_before") + F.col("_c") >= rank))
            .first()
        )
        if found is None:
            return None
        rank -= found["_before"]
        scope = scope.where(part == found["_s"])
    cut = scope.orderBy("h").limit(rank).agg(F.max("h").alias("h")).first().h
    if scope.where(F.col("h") <= cut).count() != rank:
        raise ValueError(f"{key} is not unique: no exact sample of {n} rows")
    return cut


def split_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(exactly n random rows, the rest). The split itself is a filter: no shuffle."""
    cut = cut_hash(df, key, n, seed)
    if cut is None:
        return df, df.where(F.lit(False))
    h = hash_order(key, seed)
    return df.where(h <= cut), df.where(h > cut)


def sample_at_most(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """All rows, or exactly n random ones when there are more."""
    if n is None:
        return df
    return split_exact(df, key, n, seed)[0]


def ranked(df: DataFrame, key: str, by: Sequence[str] = (), seed: int = 42, name: str = "rank") -> DataFrame:
    """Number rows 1.. in hash order within ``by``; rows of one key by their columns in turn, nulls first.

    The rows are dealt by ranges of (by, hash, columns, number at the source) and numbered in each range;
    ranges and groups then begin where the counts of those before them end. No window and no
    group is involved, so a key or a group with most of the rows spreads over many ranges, rows
    equal in all columns included. The rows are written once before, which fixes their number at the
    source, and once with their place.
    """
    by = list(by)
    ordered = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    own = settle(df.withColumns({"_h": hash_order(key, seed), "_i": F.monotonically_increasing_id()}), "ranked")
    order = [*by, "_h", *(c for c in ordered if c not in by), "_i"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(dealt.withColumn("_p", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("_p", 33), F.col("_p").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_r")).count().orderBy("_r").collect()  # one row a range
    ahead = list(itertools.accumulate((r[1] for r in sizes), initial=1))
    offsets = df.sparkSession.createDataFrame([(r[0], a) for r, a in zip(sizes, ahead)], "_r long, _a long")
    found = placed.withColumn("_r", part).join(F.broadcast(offsets), "_r").withColumn("_n", inside + F.col("_a"))
    if not by:
        return found.select(*df.columns, F.col("_n").alias(name))
    begins = found.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min("_n").alias("_b"))
    same = functools.reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by))  # null groups are groups of their own
    return found.join(begins, same).select(*df.columns, (F.col("_n") - F.col("_b") + 1).alias(name))


def epoch_shuffle(df: DataFrame, key: str, epoch: int) -> DataFrame:
    """A fresh order for each epoch; a distributed range sort on the hash."""
    return df.orderBy(hash_order(key, epoch))


def mixture(
    sources: Sequence[tuple[str, DataFrame]],
    key: str,
    ratios: Sequence[float] | None = None,
    draws: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Draw with replacement: a source by ratio, then one of its rows uniformly.

    ``ratios`` default to equal and must sum to one; ``draws`` defaults to the total
    length. Returns (draw, source, rank, row columns…). Both sides of the join are
    keyed by (source, rank), which is even on either side.
    """
    ratios = list(ratios) if ratios is not None else [1.0 / len(sources)] * len(sources)
    if len(ratios) != len(sources):
        raise ValueError("one ratio per source")
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    pool = None
    for name, frame in sources:
        tagged = frame.withColumn("source", F.lit(name))
        pool = tagged if pool is None else pool.unionByName(tagged)
    lengths = {r.source: r.n for r in pool.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(lengths.values())
    empty = [name for (name, _), ratio in zip(sources, ratios) if ratio > 0 and not lengths.get(name)]
    if empty and draws != 0:
        raise ValueError(f"nothing to draw from: {empty}")
    spark = pool.sparkSession
    ticket = F.md5(F.concat(F.lit(f"{seed}|draw|"), F.col("id").cast("string")))
    u1, u2 = _first_unit(ticket, 1), _first_unit(ticket, 9)
    edge, pick, size = 0.0, None, None
    for i, ((name, _), ratio) in enumerate(zip(sources, ratios)):
        edge += ratio
        here = (u1 < F.lit(edge)) if i < len(sources) - 1 else F.lit(True)
        n = F.lit(lengths.get(name, 0))
        pick = F.when(here, F.lit(name)) if pick is None else pick.when(here, F.lit(name))
        size = F.when(here, n) if size is None else size.when(here, n)
    drawn = spark.range(draws if draws is not None else total).select(
        F.col("id").alias("draw"), pick.alias("source"), (F.floor(u2 * size) + 1).alias("rank")
    )
    return drawn.join(ranked(pool, key, ["source"], seed), ["source", "rank"])
