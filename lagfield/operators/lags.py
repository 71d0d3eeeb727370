"""Multi-offset look-ups in a time series.

The exact look-up (``attach_lags``) packs the series into *strided blocks*: for a
lag step of s grid units, the points of one residue class modulo s form a
sub-series in which successive lags are neighbours. Cut into fixed-length blocks,
each carrying the tail of its predecessor, the whole lag vector of a row is then
one ``slice`` of one array: a single equi-join per lag group, no row explosion and
no re-grouping, whatever the number of lags.

Blocks cost about eight bytes per grid point. While that stays below a limit
(measured from the series' span, not guessed) they are broadcast, and the
observation table is never shuffled. Beyond it the look-up runs on the distinct
instants, by shuffle, and is joined back once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.functions.timeops import from_micros, half_even_index, micros
from lagfield.operators.bounded import settle
from lagfield.operators.keyed import laid_out
from lagfield.schema import LagSpec

BROADCAST_BYTES = 256 * 1024 * 1024
BLOCK_SPAN = 8  # block length as a multiple of the lag count


def _block_entries(spec: LagSpec) -> int:
    return max(512, BLOCK_SPAN * spec.count)


def _grid_index(ts: str, spec: LagSpec) -> Column:
    """Grid number of an instant; off-grid instants are null unless rounding is on."""
    us = micros(ts)
    if spec.half_even:
        return half_even_index(us, spec.unit_us)
    on_grid = F.pmod(us, F.lit(spec.unit_us)) == 0
    return F.when(on_grid, F.call_function("div", us, F.lit(spec.unit_us)))


def series_blocks(series: DataFrame, ts: str, value: str, spec: LagSpec) -> DataFrame:
    """(phase, block, history): histories newest first, null where the series has a gap."""
    m, n, s = _block_entries(spec), spec.count, spec.step
    size = m + n - 1
    exact = LagSpec(spec.unit_us, s, n)
    points = (
        series.select(_grid_index(ts, exact).alias("g"), F.col(value).cast("double").alias("v"))
        .where("g IS NOT NULL AND v IS NOT NULL")
        .select(F.pmod("g", F.lit(s)).alias("phase"), F.floor(F.col("g") / s).alias("j"), "v")
    )
    owner = lambda j: F.floor(j / m).cast("bigint")
    spread = points.select(
        "phase",
        "j",
        "v",
        F.explode(F.sequence(owner(F.col("j")), owner(F.col("j") + (n - 1)))).alias("block"),
    )
    slot = (F.col("block") * m + (m - 1) - F.col("j")).cast("int")
    grouped = spread.groupBy("phase", "block").agg(
        F.array_sort(F.collect_list(F.struct(slot.alias("i"), F.col("v").alias("v")))).alias("e")
    )
    packed = grouped.select("phase", "block", laid_out(F.col("e"), size).alias("h"))
    # A doubled instant would shift every later entry, so it must not pass.
    doubled = F.raise_error(F.lit("series instants are not unique")).cast("array<double>")
    return packed.select("phase", "block", F.when(F.size("h") == size, F.col("h")).otherwise(doubled).alias("history"))


def _look_up(rows: DataFrame, ts: str, blocks: DataFrame, out: str, spec: LagSpec) -> DataFrame:
    m, n, s = _block_entries(spec), spec.count, spec.step
    g = _grid_index(ts, spec)
    j = F.floor(g / s).cast("bigint")
    keyed = rows.withColumns({"_p": F.pmod(g, F.lit(s)), "_j": j})
    keyed = keyed.withColumn("_b", F.floor(F.col("_j") / m).cast("bigint"))
    b = blocks.select(F.col("phase").alias("_p"), F.col("block").alias("_b"), F.col("history").alias("_h"))
    start = (F.col("_b") * m + m - F.col("_j")).cast("int")
    empty = F.array_repeat(F.lit(None).cast("double"), n)
    vector = F.coalesce(F.slice("_h", start, n), empty)
    return keyed.join(b, ["_p", "_b"], "left").select(*rows.columns, vector.alias(out))


def block_bytes(groups: Sequence[tuple[DataFrame, str, str, str, LagSpec]]) -> int:
    """Upper bound of the packed size of all groups, from the spans of their series:
    grid points spanned, times eight, plus the repeated tails. One small job."""
    keyed = {(id(series), ts): (series, ts) for series, ts, *_ in groups}
    number = {k: i for i, k in enumerate(keyed)}
    spans = None
    for k, (series, ts) in keyed.items():
        ends = series.agg(F.min(micros(ts)).alias("a"), F.max(micros(ts)).alias("b"))
        ends = ends.select(F.lit(number[k]).alias("i"), "a", "b")
        spans = ends if spans is None else spans.unionByName(ends)
    span = {r.i: (r.a, r.b) for r in spans.where("a IS NOT NULL").collect()}  # one row per series
    total = 0
    for series, ts, *_, spec in groups:
        if number[id(series), ts] in span:
            a, b = span[number[id(series), ts]]
            m = _block_entries(spec)
            blocks = ((b - a) // spec.unit_us + 1) // (spec.step * m) + 3
            total += 8 * blocks * spec.step * (m + spec.count)
    return total


def attach_lags(
    rows: DataFrame,
    ts: str,
    groups: Sequence[tuple[DataFrame, str, str, str, LagSpec]],
    broadcast_bytes: int = BROADCAST_BYTES,
    nearest: Sequence[str] = (),
) -> DataFrame:
    """Add one lag array per group; a group is (series, its time, its value, output, spec).

    Groups whose output is in ``nearest`` take the value of the nearest key instead (see
    ``nearest_on_grid``); their specs must round.

    Element k of an array is the series value exactly k·step before the row's
    instant (the rounded instant when the spec rounds), null when there is none.
    Series instants must be unique.
    """
    for *_, out, spec in groups:
        if spec.half_even and (spec.step % 2) and spec.count > 1:
            raise ValueError("half-even rounding of odd steps needs attach_lags_by_join")
        if out in nearest and not spec.half_even:
            raise ValueError("nearest keys are known on the grid only: the spec must round")
    fits = block_bytes(groups) <= broadcast_bytes
    base = rows if fits else rows.select(ts).distinct()
    for series, s_ts, value, out, spec in groups:
        own = nearest_on_grid(series, s_ts, value, spec.unit_us) if out in nearest else series
        blocks = series_blocks(own, s_ts, value, spec)
        base = _look_up(base, ts, F.broadcast(blocks) if fits else blocks, out, spec)
        if out in nearest:
            base = _beyond_ends(base, ts, series, s_ts, value, out, spec)
    if fits:
        return base
    keyed = base.withColumnRenamed(ts, "_t")
    return rows.join(keyed, rows[ts].eqNullSafe(keyed["_t"]), "left").drop("_t")


def attach_lags_by_join(
    rows: DataFrame, ts: str, series: DataFrame, s_ts: str, value: str, out: str, spec: LagSpec
) -> DataFrame:
    """Same result as ``attach_lags`` for any step, rounding and off-grid instants.

    Explodes the lags of the distinct instants, so it moves count-times as many
    rows; prefer ``attach_lags`` wherever the series lies on a grid.
    """
    step_us = spec.step * spec.unit_us
    lagged = (
        rows.select(ts)
        .where(F.col(ts).isNotNull())
        .distinct()
        .select(ts, F.explode(F.sequence(F.lit(0), F.lit(spec.count - 1))).alias("_k"))
        .withColumn("_u", micros(ts) - F.col("_k").cast("bigint") * F.lit(step_us))
    )
    if spec.half_even:
        lagged = lagged.withColumn("_u", half_even_index("_u", spec.unit_us) * F.lit(spec.unit_us))
    values = series.select(micros(s_ts).alias("_u"), F.col(value).cast("double").alias("_v"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"])
    per_ts = lagged.join(values, "_u", "left").groupBy(ts).agg(vector.alias(out))
    empty = F.array_repeat(F.lit(None).cast("double"), spec.count)
    joined = rows.join(per_ts, ts, "left")
    return joined.select(*rows.columns, F.coalesce(out, empty).alias(out))


def attach_instant(
    rows: DataFrame,
    ts: str,
    series: DataFrame,
    s_ts: str,
    value: str,
    out: str,
    spec: LagSpec,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One value per row, looked up at the rounded instant."""
    got = attach_lags(rows, ts, [(series, s_ts, value, out, spec)], broadcast_bytes)
    return got.withColumn(out, F.get(out, F.lit(0)))


def widen(df: DataFrame, arrays: dict[str, int]) -> DataFrame:
    """Replace lag arrays by numbered columns ``name_0…``, in one projection.

    SQL text, since a wide row built expression by expression is slow to plan.
    """
    cols = []
    for c in df.columns:
        if c in arrays:
            cols += [f"get(`{c}`, {i}) AS `{c}_{i}`" for i in range(arrays[c])]
        else:
            cols.append(f"`{c}`")
    return df.selectExpr(*cols)


# -- nearest ----------------------------------------------------------------


RATIO = 64  # widths of neighbouring interval levels
LEVELS = 10  # the widest level, 64 ** 10 doubled microseconds, is longer than any calendar


def _whole(u, width: int) -> Column:
    """floor(u / width) in integers, exact for any microsecond count."""
    u = F.col(u) if isinstance(u, str) else u
    return F.call_function("div", u - F.pmod(u, F.lit(width)), F.lit(width))


def _with_neighbours(series: DataFrame, ts: str, value: str) -> tuple[DataFrame, int, int] | None:
    """(each key u, v with its previous and next key p and n; the first key; the last), None without keys.

    The keys are written once, range-partitioned, so partitions are even whatever the
    cadence. Neighbours come from a window inside each partition; its first and last key
    borrow from the next partition that has keys, known from one row a partition.
    """
    from pyspark.sql import Window as W

    points = series.where(F.col(ts).isNotNull()).select(micros(ts).alias("u"), F.col(value).alias("v"))
    keys = settle(points.repartitionByRange("u").withColumn("part", F.spark_partition_id()), "keys")
    ends = keys.groupBy("part").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).collect()  # one row a partition
    if not ends:
        return None
    ends.sort(key=lambda e: e.lo)
    before, after = [None, *(e.hi for e in ends[:-1])], [*(e.lo for e in ends[1:]), None]
    edges = keys.sparkSession.createDataFrame(
        [(e.part, b, a) for e, b, a in zip(ends, before, after)], "part int, before long, after long"
    )
    inside = W.partitionBy("part").orderBy("u")
    near = keys.withColumns({"p": F.lag("u").over(inside), "n": F.lead("u").over(inside)}).join(F.broadcast(edges), "part")
    near = near.select("u", "v", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    return near, ends[0].lo, ends[-1].hi


def attach_nearest(
    rows: DataFrame, ts: str, series: DataFrame, s_ts: str, value: str, out: str, key_out: str | None = None
) -> DataFrame:
    """Value of the series key nearest in time, both directions, no tolerance.

    A tie goes to the later key; before the first and after the last key those
    apply. The nearest *key* decides, even when its value is null.

    Every key owns the interval of instants nearest to it. Intervals do not overlap, and
    each is laid onto buckets about as wide as itself: it meets at most two, and a bucket
    meets at most some sixty, whether keys are clustered or far apart. A row looks
    into one bucket of each width that occurs (one, for an even cadence). Rows are never
    sorted or windowed, so many rows in one bucket are no problem.
    """
    found = _with_neighbours(series, s_ts, value)
    if found is None:
        extra = {out: F.lit(None).cast(series.schema[value].dataType)}
        if key_out:
            extra[key_out] = F.lit(None).cast("timestamp_ntz")
        return rows.withColumns(extra)
    near, first, last = found
    # Doubled microseconds keep midpoints integral: row u belongs here if lo2 <= 2u < hi2.
    owned = near.select(
        "u",
        "v",
        F.coalesce(F.col("p") + F.col("u"), F.col("u") * 2).alias("lo2"),
        F.coalesce(F.col("u") + F.col("n"), F.col("u") * 2 + 1).alias("hi2"),
    ).where("lo2 < hi2")
    length = F.col("hi2") - F.col("lo2")
    owned = owned.withColumn("level", sum(((length > RATIO**k).cast("int") for k in range(1, LEVELS)), F.lit(0)))
    levels = sorted(r.level for r in owned.select("level").distinct().collect())  # at most LEVELS rows
    # greatest/least skip nulls: a row without time must not inherit a bucket.
    u2 = micros(ts) * 2
    u2 = F.when(F.col(ts).isNotNull(), F.greatest(F.least(u2, F.lit(2 * last)), F.lit(2 * first)))
    joined = rows.withColumn("_u2", u2)
    key, chosen = F.lit(None).cast("bigint"), F.lit(None).cast(series.schema[value].dataType)
    for level in levels:
        width = RATIO ** (level + 1)
        k, v, lo, hi, b = (f"_{x}{level}" for x in ("k", "v", "lo", "hi", "b"))
        laid = owned.where(F.col("level") == level).select(
            F.col("u").alias(k),
            F.col("v").alias(v),
            F.col("lo2").alias(lo),
            F.col("hi2").alias(hi),
            F.explode(F.sequence(_whole("lo2", width), _whole(F.col("hi2") - 1, width))).alias(b),
        )
        hit = (_whole("_u2", width) == F.col(b)) & (F.col(lo) <= F.col("_u2")) & (F.col("_u2") < F.col(hi))
        joined = joined.join(laid, hit, "left")
        key, chosen = F.coalesce(k, key), F.when(F.col(k).isNotNull(), F.col(v)).otherwise(chosen)
    cols = [*rows.columns, chosen.alias(out)]
    if key_out:
        cols.append(from_micros(key).alias(key_out))
    return joined.select(*cols)


# Grid points whose nearest keys are found in one window.
STRETCH = 4096


def nearest_on_grid(series: DataFrame, ts: str, value: str, unit_us: int) -> DataFrame:
    """(ts, value) at every grid point from the first key to the last: the value of the nearest key, a tie to the later.

    Of the keys between two grid points only the first and the last can be nearest to one, so the
    series is reduced to those first. The grid is cut into stretches of ``STRETCH`` points; inside
    one, windows find the neighbours on either side, and what lies beyond comes from one row a
    stretch. A plan of aggregates and windows: nothing runs when it is built.
    """
    from pyspark.sql import Window as W

    points = series.where(F.col(ts).isNotNull()).select(F.struct(micros(ts).alias("u"), F.col(value).alias("v")).alias("k"))
    cells = points.groupBy(_whole("k.u", unit_us).alias("g")).agg(F.min("k").alias("first"), F.max("k").alias("last"))
    stretch = F.floor(F.col("g") / STRETCH).cast("bigint")
    ends = cells.agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a IS NOT NULL")
    # The last key may lie between its cell's grid point and the next one.
    stretches = ends.select(
        "a", "b", F.explode(F.sequence(_whole("a", STRETCH), _whole(F.col("b") + 1, STRETCH))).alias("s")
    )
    of_stretch = cells.groupBy(stretch.alias("s")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    along = W.orderBy("s")  # one row a stretch
    known = stretches.join(of_stretch, "s", "left").select(
        "s",
        "a",
        "b",
        F.last("last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("after"),
    )
    grid = known.select(
        "*", F.explode(F.sequence(F.greatest("a", F.col("s") * STRETCH), F.least(F.col("b") + 1, (F.col("s") + 1) * STRETCH - 1))).alias("g")
    )
    inside = W.partitionBy("s").orderBy("g")
    near = grid.join(cells, "g", "left").select(
        "g",
        F.coalesce(F.last("last", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)), "before").alias("p"),
        F.coalesce(F.first("first", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing)), "after").alias("n"),
    )
    at = F.col("g") * F.lit(unit_us)
    earlier = F.col("n").isNull() | (F.col("p").isNotNull() & (at - F.col("p.u") < F.col("n.u") - at))
    return near.select(from_micros(at).alias(ts), F.when(earlier, F.col("p.v")).otherwise(F.col("n.v")).alias(value))


def _beyond_ends(rows: DataFrame, ts: str, series: DataFrame, s_ts: str, value: str, out: str, spec: LagSpec) -> DataFrame:
    """Lags before the first key or after the last one take its value."""
    key = F.struct(micros(s_ts).alias("u"), F.col(value).cast("double").alias("v"))
    points = series.where(F.col(s_ts).isNotNull()).select(key.alias("k"))
    ends = F.broadcast(points.agg(F.min("k").alias("_first"), F.max("k").alias("_last")))  # one row
    at = lambda k: (_grid_index(ts, spec) - k * spec.step) * F.lit(spec.unit_us)
    value_at = lambda x, k: (
        F.when(at(k) < F.col("_first.u"), F.col("_first.v")).when(at(k) > F.col("_last.u"), F.col("_last.v")).otherwise(x)
    )
    return rows.crossJoin(ends).select(*[c for c in rows.columns if c != out], F.transform(out, value_at).alias(out))


def attach_nearest_lags(
    rows: DataFrame,
    ts: str,
    series: DataFrame,
    s_ts: str,
    value: str,
    out: str,
    spec: LagSpec,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Lag array by nearest key, for instants that are rounded to the grid."""
    return attach_lags(rows, ts, [(series, s_ts, value, out, spec)], broadcast_bytes, nearest=[out])
