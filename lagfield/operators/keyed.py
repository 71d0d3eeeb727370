"""Key-wise operators: first row per key, distinct, dense pivots, joins by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregate, not a window: duplicates collapse before the shuffle, so a hot
    key sends one row per task. ``order`` must be unique within a key.
    """
    pick = F.min_by(F.struct(*values), order).alias("_v")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col("_v")[v].alias(v) for v in values])


# Equal rows that are numbered in one go.
BLOCK = 4096


def with_row_key(df: DataFrame, name: str = "row_key", block: int = BLOCK) -> DataFrame:
    """``df`` with a unique text key that depends on the rows alone, not on files or tasks.

    The key is a hash of the whole row and a number among equal rows. Equal rows are
    combined before the one shuffle this takes, and unfolded after it: first into blocks of
    ``block`` numbers, which are dealt out over all tasks, then each block into its rows. So a
    row that makes up a third of the table unfolds in parallel, and no array exceeds a block.
    """
    number, copies, first = f"_{name}_i", f"_{name}_n", f"_{name}_b"
    whole = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
    several = folded.where(F.col(copies) > block)
    # The blocks of many copies: numbers of blocks by two steps, so that no sequence is longer than a block either.
    step = F.lit(block).cast("bigint")

    def ranges(rows: DataFrame, begin: str, last: Column, width: Column, out: str) -> DataFrame:
        return rows.withColumn(out, F.explode(F.sequence(F.col(begin), last, width)))

    outer = ranges(several.withColumn(first, F.lit(1).cast("bigint")), first, F.col(copies), step * step, f"{first}0").drop(first)
    outer_end = F.least(F.col(f"{first}0") + step * step - 1, F.col(copies))
    blocks = ranges(outer, f"{first}0", outer_end, step, first).drop(f"{first}0")
    dealt = blocks.repartition(F.xxhash64(first, *df.columns[:1]))
    few = folded.where(F.col(copies) <= block).withColumn(first, F.lit(1).cast("bigint"))
    each = few.select(*df.columns, copies, first).unionByName(dealt.select(*df.columns, copies, first))
    last = F.least(F.col(first) + block - 1, F.col(copies))
    each = ranges(each, first, last, F.lit(1).cast("bigint"), number)
    return each.withColumn(name, F.concat_ws("-", whole, F.col(number))).drop(number, copies, first)


def per_distinct(df: DataFrame, key: str, compute: dict[str, Column]) -> DataFrame:
    """Evaluate costly columns once per distinct key and attach them to every row.

    Adaptive execution broadcasts the key table if its bytes turn out few, and splits a
    hot key of the row side otherwise. Null is a key like any other.
    """
    keys = df.select(key).distinct().select(F.col(key).alias("_key"), *[v.alias(n) for n, v in compute.items()])
    return df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def pivot_cells(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long to wide; two values for one cell are an error, absent cells are null."""
    cell = F.when(F.count(value) <= 1, F.max(value)).otherwise(
        F.raise_error(F.lit("duplicate cell")).cast("double")
    )
    return df.groupBy(row).pivot(column, list(columns)).agg(cell)


def laid_out(entries: Column, size: int) -> Column:
    """An array of ``size`` values from (i, v) entries sorted by i: each v at place i, null elsewhere.

    Longer than ``size`` if a place comes twice; the caller decides what that means.
    """
    kind = "double"
    gap = lambda k: F.array_repeat(F.lit(None).cast(kind), k)
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(entries, k - 1)["i"])
    filled = F.flatten(F.transform(entries, lambda x, k: F.concat(gap(F.greatest(x["i"] - before(k) - 1, F.lit(0))), F.array(x["v"]))))
    return F.concat(filled, gap(F.greatest(F.lit(size - 1) - F.element_at(entries, F.lit(-1))["i"], F.lit(0))))


def pivot_dense(df: DataFrame, row: str, position: Column, value: str, size: int, name: str = "cells") -> DataFrame:
    """(row, cells): the cells of each row in one array of ``size`` places; absent cells are null.

    ``position`` is a cell's place from 0. A doubled cell, and a place that is none, are errors. The plan is
    as wide for a thousand columns as for two.
    """
    place = position.cast("int")
    outside = F.raise_error(F.lit(f"a cell has no place from 0 to {size - 1}")).cast("int")
    inside = F.when((place >= 0) & (place < size), place).otherwise(outside)
    cell = F.struct(inside.alias("i"), F.col(value).cast("double").alias("v"))
    packed = df.select(row, cell.alias("_c")).groupBy(row).agg(F.array_sort(F.collect_list("_c")).alias("_e"))
    laid = packed.select(row, laid_out(F.col("_e"), size).alias(name))
    doubled = F.raise_error(F.lit("duplicate cell")).cast("array<double>")
    return laid.select(row, F.when(F.size(name) == size, F.col(name)).otherwise(doubled).alias(name))


def attach_by_key(df: DataFrame, scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach separately computed columns by key; each row must find exactly one.

    The check rides in the plan: a missing or doubled key fails the job that reads the
    attached columns. One shuffle per side, nothing is run beforehand.
    """
    key = list(key)
    new = [c for c in scored.columns if c not in key]
    packed = scored.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in new])
    joined = df.join(packed, key, "left")
    wrong = F.raise_error(F.lit("a row was not scored exactly once"))
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    checked = [F.when(F.col("_n") == 1, F.col(c)).otherwise(wrong.cast(kinds[c])).alias(c) for c in new]
    return joined.select(*df.columns, *checked)
