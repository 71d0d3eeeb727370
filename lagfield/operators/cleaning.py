"""Row filters, sentinel handling, schema checks and the row-attrition audit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.schema import INVALID_VALUES

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def keep_existing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Project to the wanted columns that exist; also return the missing names.

    With none present, every column is kept.
    """
    present = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    return (df.select(*present) if present else df), missing


def require_columns(df: DataFrame, columns: Iterable[str], exact: bool = False) -> DataFrame:
    want, have = set(columns), set(df.columns)
    if want - have:
        raise ValueError(f"missing columns: {sorted(want - have)}")
    if exact and have - want:
        raise ValueError(f"unexpected columns: {sorted(have - want)}")
    return df


def require_types(df: DataFrame, types: dict[str, type[T.DataType]]) -> DataFrame:
    for name, kind in types.items():
        if not isinstance(df.schema[name].dataType, kind):
            raise TypeError(f"{name} is {df.schema[name].dataType}, expected {kind.__name__}")
    return df


def add_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    new = {c: F.lit(None).cast("double") for c in columns if c not in df.columns}
    return df.withColumns(new) if new else df


def ordered(df: DataFrame, order: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Rename, then project to the columns of ``order`` that exist, in that order."""
    df = df.withColumnsRenamed(rename or {})
    return df.select(*[c for c in order if c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


# -- predicates -------------------------------------------------------------


def any_equals(columns: Sequence[str], value: float) -> Column:
    """True when any column holds the value; a null never does."""
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).eqNullSafe(F.lit(value))
    return test


def drop_sentinel_rows(df: DataFrame, columns: Sequence[str], value: float = 999.0) -> DataFrame:
    return df.where(~any_equals(columns, value))


def in_window(ts: str, start: str, end: str) -> Column:
    """start <= ts < end."""
    t = F.col(ts)
    return (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))


def outside_window(ts: str, start: str, end: str) -> Column:
    """Complement of the window; rows without a time belong here."""
    return ~F.coalesce(in_window(ts, start, end), F.lit(False))


def in_days(ts: str, first_day: str, last_day: str) -> Column:
    """Both days included. Day strings must read yyyy-MM-dd, else ValueError."""
    from datetime import datetime, timedelta

    first = datetime.strptime(first_day, "%Y-%m-%d")
    after = datetime.strptime(last_day, "%Y-%m-%d") + timedelta(days=1)
    return in_window(ts, first.isoformat(sep=" "), after.isoformat(sep=" "))


def present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def finite(c: str) -> Column:
    return present(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


# Local-time sectors of the altitude profiles.
def sectors(gmlt: str) -> Column:
    """All sectors a row belongs to: day (10,17), night (>22 or <4), all."""
    h = F.col(gmlt)
    tags = F.array(
        F.when((h > 10) & (h < 17), F.lit("day")),
        F.when((h > 22) | (h < 4), F.lit("night")),
        F.lit("all"),
    )
    return F.array_compact(tags)


# -- sentinels and nulls ----------------------------------------------------


def sentinel_to_null(c, values: Sequence[float]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.coalesce(c.isin(*[float(v) for v in values]), F.lit(False)), c)


def _listed(values: Sequence[float]) -> str:
    return ", ".join(f"{float(v)!r}D" for v in values)


def _typed(values: Sequence[float], kind: T.DataType) -> list[str]:
    """SQL literals, of exactly the type ``kind``, of those values that it can hold."""
    name, out = kind.simpleString(), []
    for v in map(float, values):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(f"CAST({v!r}D AS {name})")
        elif isinstance(kind, T.DecimalType):
            exact = Decimal(repr(v)).normalize()
            _, digits, exponent = exact.as_tuple()
            if -exponent <= kind.scale and len(digits) + exponent <= kind.precision - kind.scale:
                out.append(f"CAST('{exact:f}' AS {name})")
        elif v.is_integer() and -(2 ** (BITS[type(kind)] - 1)) <= v < 2 ** (BITS[type(kind)] - 1):
            out.append(f"CAST({int(v)}L AS {name})")
    return out


def _replaced(c: str, kind: T.DataType, values: Sequence[float], replacement: float) -> str:
    bad, new = _typed(values, kind), _typed([replacement], kind)
    if not bad:
        return c
    if not new:
        raise ValueError(f"{kind.simpleString()} cannot hold {replacement}")
    return f"CASE WHEN {c} IN ({', '.join(bad)}) THEN {new[0]} ELSE {c} END"


# Feature tables have hundreds of columns, so the functions below state their
# per-column expressions as SQL text: one call plans them all.


def replace_invalid(
    df: DataFrame, values: Sequence[float] = INVALID_VALUES, replacement: float = 0.0
) -> DataFrame:
    """Replace placeholder values in every numeric column, lag arrays included.

    Each column is compared and replaced in its own type, so other values keep every digit.
    """

    def text(f: T.StructField) -> str:
        c = f"`{f.name}`"
        if isinstance(f.dataType, NUMERIC):
            return f"{_replaced(c, f.dataType, values, replacement)} AS {c}"
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, NUMERIC):
            return f"transform({c}, x -> {_replaced('x', f.dataType.elementType, values, replacement)}) AS {c}"
        return c

    return df.selectExpr(*[text(f) for f in df.schema.fields])


def count_invalid(df: DataFrame, values: Sequence[float] = INVALID_VALUES) -> DataFrame:
    """(value, hits) over all numeric columns and lag arrays, for the values that occur.

    One pass; only the hits are unfolded, and they combine before the shuffle.
    """
    scalars = ", ".join(f"CAST(`{c}` AS double)" for c in numeric_columns(df))
    arrays = [
        f"CAST(`{f.name}` AS array<double>)"
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, NUMERIC)
    ]
    cells = f"concat({', '.join([f'array({scalars})', *arrays])})"
    hits = df.selectExpr(f"explode(filter({cells}, x -> x IN ({_listed(values)}))) AS value")
    return hits.groupBy("value").agg(F.count(F.lit(1)).alias("hits"))


def _missing(c: str, kind: str) -> str:
    return f"`{c}` IS NULL" + (f" OR isnan(`{c}`)" if kind in ("double", "float") else "")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, non_nulls, type) for every column in one pass."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    counts = [f"count_if({_missing(c, kinds[c])}) AS n{i}" for i, c in enumerate(columns)]
    rows = ", ".join(
        f"struct('{c}' AS column, n{i} AS nulls, total - n{i} AS non_nulls, '{kinds[c]}' AS type)"
        for i, c in enumerate(columns)
    )
    return df.selectExpr("count(1) AS total", *counts).selectExpr(f"inline(array({rows}))")


def guard_missing(df: DataFrame, required: Sequence[str], threshold_percent: float) -> DataFrame:
    """Fail if any required column misses more than the threshold, else drop rows
    that miss one; null and NaN are missing. Shares of all columns come from one aggregate row."""
    kinds = dict(df.dtypes)
    shares = df.selectExpr(*[f"avg(CAST({_missing(c, kinds[c])} AS double)) AS `{c}`" for c in required]).first()
    over = {c: shares[c] * 100 for c in required if (shares[c] or 0.0) * 100 > threshold_percent}
    if over:
        raise ValueError(f"too much missing data: {over}")
    gaps = [c for c in required if (shares[c] or 0.0) > 0]
    return df.where(" AND ".join(f"NOT ({_missing(c, kinds[c])})" for c in gaps)) if gaps else df


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null (or NaN) to zero; array columns element by element."""
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}

    def text(c: str) -> str:
        if c not in columns:
            return f"`{c}`"
        if c in arrays:
            return f"transform(`{c}`, x -> coalesce(nanvl(x, 0D), 0D)) AS `{c}`"
        return f"coalesce(nanvl(CAST(`{c}` AS double), 0D), 0D) AS `{c}`"

    return df.selectExpr(*[text(c) for c in df.columns])


def to_number(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


# -- attrition --------------------------------------------------------------


Steps = Sequence[tuple[str, Column, Column | str | None]]


def attrition(df: DataFrame, steps: Steps) -> DataFrame:
    """Rows removed and left after each cleaning step, and the range of a column.

    ``steps`` are (name, keep-predicate, watched column). All steps are counted in
    one aggregate over cumulative flags, so the input is scanned once.
    """
    return df.agg(*_attrition_metrics(steps)).select(F.inline(_attrition_rows(steps)))


def observed_attrition(df: DataFrame, steps: Steps) -> tuple[DataFrame, Observation]:
    """``df`` whose first action also takes the metrics of ``attrition``, without a scan of its own.

    What ``attrition_of`` makes of them holds if every task ran once; a lost executor may count rows twice.
    """
    seen = Observation()
    return df.observe(seen, *_attrition_metrics(steps)), seen


def attrition_of(spark: SparkSession, seen: Observation, steps: Steps) -> DataFrame:
    """The rows of ``attrition`` from the metrics of an action that has ended."""
    metrics = seen.get
    one = spark.range(1).select(*[F.lit(v).cast("double" if k[0] in "lh" else "bigint").alias(k) for k, v in metrics.items()])
    return one.select(F.inline(_attrition_rows(steps)))


def _attrition_metrics(steps: Steps) -> list[Column]:
    alive = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("c0")]
    for i, (_, keep, watch) in enumerate(steps, start=1):
        alive = alive & F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(alive).alias(f"c{i}"))
        if watch is not None:
            w = F.col(watch) if isinstance(watch, str) else watch
            aggs += [F.min(F.when(alive, w)).alias(f"lo{i}"), F.max(F.when(alive, w)).alias(f"hi{i}")]
    return aggs


def _attrition_rows(steps: Steps) -> Column:
    rows = []
    for i, (name, _, watch) in enumerate(steps, start=1):
        null = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("description"),
                (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("removed"),
                F.col(f"c{i}").alias("remaining"),
                (F.col(f"lo{i}").cast("double") if watch is not None else null).alias("low"),
                (F.col(f"hi{i}").cast("double") if watch is not None else null).alias("high"),
            )
        )
    return F.array(*rows)
