"""Exact top-k search by inner product with a pivot table (operator 11).

Method: pivot-table elimination. Every row has its Euclidean distances to ``pivots`` rows.
For a query q and a row x the largest |d(q, p) - d(x, p)| is a lower bound
of d(q, x), and since <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2 it is an upper bound of
their score. A query's candidates are evaluated in the order of that bound, and the search
stops as soon as the next bound lies below the k-th best score found. The pivots are
rows themselves, so each query begins with the k-th best score among them.

The pivots are looked at ``GROUP`` at a time. They come in the order of a hash, so a group
that eliminates less than ``GAIN`` of the pairs says the same of those after it: the pairs
that are left are then evaluated by one matrix product, which gives the same rows as the
bounds would and costs less than they do.

The table and the query set (ids divisible by ``every``) are packed into blocks and dealt
by number into a grid of cells, shares of the table by parts of the query set; each cell
is one partition, its queries first and then its rows, which stream past them while the
best k of each query are kept. There is no join, so no side is ever broadcast, and nothing
but the pivots is collected. A cell gives at most k rows a query, none below the query's
start; the best k of all follow by a window over these.

Defined results: rows whose vector is null or holds null, NaN or infinite components, and
rows without an id, take no part; a shorter vector ends in zeros; candidates are the rows
of other ids, so rows sharing the query's id are left out, and other repeated rows each
hold a rank of their own; a repeated query row is answered twice; ties go to the smaller
id; fewer candidates than k are all returned; an empty table gives no rows; other columns
are not read; components of 2^27 or more after scaling are an error.

Scale: every query meets every row, so time is the product of both counts. What is shuffled
is not: the table goes once to each part of ``PART`` x ``queries`` queries, the queries to
each share of the table, and shares are so many that the latter is about as much as the
former. A worker holds one part of the queries, some 80 MB, and one block of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfield.llm import vectors
from lagfield.llm.common import settle

TOP = 10
EVERY = 100
PIVOTS = 64
BLOCK = 4096
QUERIES = 512
# Candidates of one query evaluated between two looks at the stopping rule.
STEP = 256
# Distances are kept in single precision; bounds are loosened by this share of the largest.
SLACK = 1e-6
# Queries of one part, in blocks of ``QUERIES``; rows of one share, in blocks of ``BLOCK``, and of one packed row.
PART = 256
SHARE = 2
MOST_SHARE = 128
PACK = 1024
# Bytes that a query of k results, and a row, take up in the shuffles, in about this relation.
QUERY_COST = 2.2
# Pivots of one look, the pairs they must eliminate to go on, and the queries of one look.
GROUP = 8
GAIN = 1 / 4
LOOK = 16
# From this share of a look's pairs on, those left are evaluated by a matrix product.
DENSE = 1 / 64
# Below every score, above the rows left out; single precision holds it.
LOWEST = -3e38


def squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each pivot, single precision."""
    near = squares(rows)[:, None] + squares(pivots)[None, :] - 2 * (rows @ pivots.T)
    return np.sqrt(np.maximum(near, 0)).astype("<f4")


def upper_bounds(queries: np.ndarray, rows: np.ndarray, to_query: np.ndarray, to_row: np.ndarray) -> np.ndarray:
    """For each query and row, a number that their inner product does not exceed."""
    apart = np.zeros((len(queries), len(rows)), np.float32)
    for q, r in zip(to_query.T, to_row.T):
        np.maximum(apart, np.abs(q[:, None] - r[None, :]), out=apart)
    furthest = max(to_query.max(initial=0), to_row.max(initial=0))
    apart = np.maximum(apart.astype(np.float64) - SLACK * furthest, 0)
    sums = squares(queries)[:, None] + squares(rows)[None, :]
    return (sums - apart * apart) / 2 + SLACK * sums.max(initial=0)


def best_of(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray, start: float, k: int):
    """(ids, scores, evaluated): the ``k`` best of the rows that score ``start`` or more, best first."""
    order = np.flatnonzero(bounds >= start)
    order = order[np.argsort(-bounds[order], kind="stable")]
    own, scores, least, seen = np.empty(0, np.int64), np.empty(0), start, 0
    while seen < len(order) and bounds[order[seen]] >= least:
        at = order[seen : seen + STEP]
        seen += len(at)
        own, scores = np.append(own, ids[at]), np.append(scores, rows[at] @ query)
        best = np.lexsort((own, -scores))[:k]
        best = best[scores[best] >= start]
        own, scores = own[best], scores[best]
        if len(own) == k:
            least = scores[-1]
    return own, scores.astype(np.int64), seen


def kth_best(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf


def look(lengths: np.ndarray, row_lengths: np.ndarray, to_query: np.ndarray, to_row: np.ndarray, least: np.ndarray):
    """(pairs, gained): whether each row can score ``least`` or more with each query, by the pivots looked at.

    ``gained`` is the share that the first group of pivots and the lengths eliminate. Lengths
    are squares, and both tables of distances have a row for each pivot.
    """
    furthest = max(to_query.max(initial=0), to_row.max(initial=0))
    sums = lengths[:, None] + row_lengths[None, :]
    # As in upper_bounds: the squared distance that leaves a bound of ``least``.
    room = sums + 2 * SLACK * sums.max(initial=0) - 2 * least[:, None]
    reach = np.where(room < 0, -1, np.sqrt(np.maximum(room, 0)) * (1 + SLACK) + SLACK * furthest).astype(np.float32)
    apart, step = np.zeros_like(reach), np.empty_like(reach)
    gained, left = 0.0, apart.size
    for g in range(0, max(1, len(to_query)), GROUP):
        for q, r in zip(to_query[g : g + GROUP], to_row[g : g + GROUP]):
            np.subtract(q[:, None], r[None, :], out=step)
            np.maximum(apart, np.abs(step, out=step), out=apart)
        pairs = apart <= reach
        now = np.count_nonzero(pairs)
        if not g:
            gained = 1 - now / max(1, left)
        if now > (1 - GAIN) * left or not now:
            break
        left = now
    return pairs, gained


class Cell:
    """The best ``k`` rows so far of each query of one cell; rows come block by block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivot_ids: np.ndarray, pivots: np.ndarray, k: int, block: int):
        self.ids, self.queries, self.pivots, self.k, self.block = ids, queries, pivots, k, block
        self.far = np.empty((len(pivots), len(ids)), np.float32)
        self.least = np.full(len(ids), LOWEST)
        self.lengths = np.empty(len(ids))
        for i in range(0, len(ids), block):
            own = queries[i : i + block].astype(np.float64)
            self.lengths[i : i + block] = squares(own)
            self.far[:, i : i + block] = distances(own, pivots).T
            scores = own @ pivots.T
            scores[ids[i : i + block, None] == pivot_ids[None, :]] = -np.inf
            if len(pivots) >= k:
                self.least[i : i + block] = np.maximum(np.partition(scores, -k, axis=1)[:, -k], LOWEST)
        self.best_ids = np.zeros((len(ids), k), np.int64)
        self.best = np.full((len(ids), k), -np.inf)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order].astype(np.float64)
        to_row = np.ascontiguousarray(distances(rows, self.pivots).T)
        # Where no sum of products leaves 24 bits, single precision holds all of them.
        lengths = squares(rows)
        exact = self.lengths.max(initial=0) * lengths.max(initial=0) < 2.0**48
        flat = rows.astype(np.float32) if exact else rows
        n = max(self.block, LOOK) * len(rows)
        room = np.empty(n, flat.dtype), np.empty(n, bool)
        i = 0
        while i < len(self.ids):
            some = slice(i, i + LOOK)
            pairs, gained = look(self.lengths[some], lengths, self.far[:, some], to_row, self.least[some])
            if gained < GAIN:
                # These queries stand for their block.
                self.product(slice(i, i + self.block), ids, flat, room)
                i += self.block
                continue
            if np.count_nonzero(pairs) > DENSE * pairs.size:
                self.product(some, ids, flat, room)
            else:
                self.ordered(some, ids, rows, pairs, to_row)
            i += LOOK

    def product(self, some: slice, ids: np.ndarray, rows: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> None:
        """Evaluate all pairs of some queries and the rows (in the order of their ids); ``room`` is for scores and hits."""
        own = self.queries[some].astype(rows.dtype)
        scores, hit = (x[: len(own) * len(ids)].reshape(len(own), len(ids)) for x in room)
        np.matmul(own, rows.T, out=scores)
        first, last = (np.searchsorted(ids, self.ids[some], side) for side in ("left", "right"))
        for j in np.flatnonzero(last > first):
            scores[j, first[j] : last[j]] = -np.inf
        least = self.least[some].astype(rows.dtype)
        np.greater_equal(scores, least[:, None], out=hit)
        if np.count_nonzero(hit) > 2 * self.k * len(own) and len(ids) >= self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
            np.greater_equal(scores, least[:, None], out=hit)
        at = np.flatnonzero(hit)
        if len(at):
            self.keep(some.start + at // len(ids), ids[at % len(ids)], scores.ravel()[at].astype(np.float64))

    def ordered(self, some: slice, ids: np.ndarray, rows: np.ndarray, pairs: np.ndarray, to_row: np.ndarray) -> None:
        """Evaluate the pairs that are left, each query's in the order of their bounds."""
        own, at, found, scores = self.queries[some].astype(np.float64), [], [], []
        for j in np.flatnonzero(pairs.any(axis=1)):
            i = some.start + j
            left = np.flatnonzero(pairs[j])
            left = left[ids[left] != self.ids[i]]
            if len(left):
                bounds = upper_bounds(own[j : j + 1], rows[left], self.far[:, i : i + 1].T, to_row[:, left].T)[0]
                best, score, _ = best_of(own[j], ids[left], rows[left], bounds, self.least[i], self.k)
                at.append(np.full(len(best), i))
                found.append(best)
                scores.append(score)
        if at:
            self.keep(np.concatenate(at), np.concatenate(found), np.concatenate(scores).astype(np.float64))

    def keep(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take up rows of queries ``at``."""
        k, met = self.k, np.unique(at)
        at = np.concatenate([np.repeat(met, k), at])
        ids = np.concatenate([self.best_ids[met].ravel(), ids])
        scores = np.concatenate([self.best[met].ravel(), scores])
        order = np.lexsort((ids, -scores, at))
        # Each of these queries has k entries at least.
        first = np.searchsorted(at[order], met)
        top = order[first[:, None] + np.arange(k)[None, :]]
        self.best_ids[met], self.best[met] = ids[top], scores[top]
        self.least[met] = np.maximum(self.least[met], self.best[met, -1])


def _blocks(rows: DataFrame, block: int, width: int) -> DataFrame:
    """Rows (id, v) packed, up to ``block`` of a partition together: number of the block, ids, components."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(own: pa.Table) -> pa.RecordBatch:
            parts = vectors.matrix(own.column(1), width)
            small = not parts.size or np.abs(parts).max() < 2**15
            ids = own.column(0).to_numpy().astype("<i8")
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (ids, parts.astype("<i2" if small else "<i4"))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *cells], ["number", "ids", "parts"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                all_ = pa.Table.from_batches(held)
                while n >= block:
                    yield out(all_.slice(0, block))
                    all_, n, number = all_.slice(block), n - block, number + 1
                held = all_.to_batches()
        if n:
            yield out(pa.Table.from_batches(held))

    return rows.mapInArrow(packed, "number long, ids binary, parts binary")


def _grid(n: int, asked: int, block: int, queries: int) -> tuple[int, int]:
    """(shares of the table, parts of the query set)."""
    parts = -(-asked // (PART * queries))
    few = -(-n // (MOST_SHARE * block))
    return max(few, min(-(-n // (SHARE * block)), int(n * parts / (QUERY_COST * asked))), 1), parts


def search(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_query: Column | None = None,
    k: int = TOP,
    n_pivots: int = PIVOTS,
    block: int = BLOCK,
    queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best rows of other ids.

    ``is_query`` is a condition on the column ``id``; by default ids divisible by 100.
    """
    spark = rows.sparkSession
    is_query = F.col("id") % EVERY == 0 if is_query is None else is_query
    own = settle(vectors.kept(rows, id_col, vector_col).where("id IS NOT NULL"), "vectors")
    n, asked, width = own.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    nothing = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], nothing)
    # At most n_pivots rows, spread by a hash of their ids.
    chosen = own.orderBy(F.xxhash64("id"), "id", "v").limit(n_pivots).toArrow()
    pivot_ids, pivots = chosen.column("id").to_numpy(), vectors.matrix(chosen.column("v"), width).astype(np.float64)

    shares, parts = _grid(n, asked, block, queries)
    # Blocks are dealt in turn, each partition's from a place of its own; each meets every cell of its share or part.
    turn = F.shiftright("number", 32) * 7919 + F.col("number") % 2**32

    def placed(blocks: DataFrame, side: int, others: int, cell: Callable[[Column], Column]) -> DataFrame:
        each = F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda x: cell(x).cast("int"))
        return blocks.select(F.explode(each).alias("cell"), F.lit(side).alias("side"), "*")

    asking = placed(_blocks(own.where(is_query), min(queries, PACK), width), 0, shares, lambda x: x * parts + turn % parts)
    there = placed(_blocks(own, min(block, PACK), width), 1, parts, lambda x: turn % shares * parts + x)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One partition is one cell, queries first.
        questions, slots, held, cell = [], [], [], None

        def unpacked(ids: bytes, components: bytes) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(ids, "<i8")
            kind = "<i4" if len(components) == 4 * width * len(ids) else "<i2"
            return ids, np.frombuffer(components, kind).reshape(len(ids), width)

        def joined(own: list) -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])

        for batch in batches:
            for number, side, *packed in zip(*(batch.column(c).to_pylist() for c in ("number", "side", "ids", "parts"))):
                ids, rows = unpacked(*packed)
                if not side:
                    questions.append((ids, rows))
                    slots.append(np.stack([np.full(len(ids), number), np.arange(len(ids))]))
                    continue
                if not questions:
                    return
                cell = cell or Cell(*joined(questions), pivot_ids, pivots, k, queries)
                held.append((ids, rows))
                if sum(len(x) for x, _ in held) >= block:
                    cell.meet(*joined(held))
                    held = []
        if cell is None:
            return
        if held:
            cell.meet(*joined(held))
        slots = np.concatenate(slots, axis=1)
        for i in range(0, len(cell.ids), PACK):
            at, which = np.nonzero(cell.best[i : i + PACK] > -np.inf)
            at += i
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots[0, at]),
                    pa.array(slots[1, at].astype(np.int32)),
                    pa.array(cell.ids[at]),
                    pa.array(cell.best_ids[at, which]),
                    pa.array(cell.best[at, which].astype(np.int64)),
                ],
                ["qb", "slot", "query_id", "vec_id", "score"],
            )

    cells = asking.union(there).repartitionById(shares * parts, F.col("cell")).sortWithinPartitions("side")
    found = cells.mapInArrow(answered, "qb long, slot int, query_id long, vec_id long, score long")
    order = W.partitionBy("qb", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
