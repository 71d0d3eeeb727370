"""Vector codes: product quantisation whose nearest entries are found by Orchard's search (operator 12).

Method: every codebook keeps, for each of its entries, all entries sorted by distance from
it. A search stands at an entry, goes down that entry's list and jumps to the list of the
first block of entries that holds a nearer one; entries looked at are marked, and the search ends where
the list's next entry is more than twice as far from the current one as the query is, since by
the triangle inequality nothing from there on can be as near. Many vectors search at once,
each with its own place, list and marks; distances are integers, so ties are exact.

Codebooks begin as the parts of the vectors with the smallest ids. Each of the rounds is one
Spark job over the integer vectors: tasks emit one row of sums for each entry in use, those combine
before the driver takes them (at most parts x entries rows), and the next books go out with
the next job.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite components are
dropped; with fewer rows than entries a book has that many; rows sharing an id are ordered
by their components, null ids come last; ties go to the lower entry; null labels are
one label; repeated rows get a row each; an empty table gives no rows; other columns are not
read; vectors of different lengths, or of one that the number of parts does not divide, and
components of 2^27 or more after scaling are errors.

Scale: vectors are never shuffled; books, lists and sums have the size that parts, entries and width
give. A label that a third of all rows carry is one sum a task, and the join that brings
it back has one row a label on one side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm import vectors
from lagfield.llm.common import settle

PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Vectors that search together, and entries of a list looked at between two jumps.
TOGETHER = 2048
STEP = 16


@dataclass
class Book:
    """Entries of one part and, for each, all entries by distance from it (itself first)."""

    entries: np.ndarray
    lists: np.ndarray
    far: np.ndarray
    start: int

    @staticmethod
    def of(entries: np.ndarray) -> Book:
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        lists = np.argsort(apart, axis=1, kind="stable")
        # Searches begin at the entry with the least sum of distances to the others.
        return Book(entries, lists, np.take_along_axis(apart, lists, axis=1), int(apart.sum(axis=1).argmin()))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) nearest to each point, ties to the lower entry, and how many distances that took."""
        n, size = len(points), len(self.entries)
        entry = np.full(n, self.start)
        best = ((points - self.entries[self.start]) ** 2).sum(axis=1)
        marked = np.zeros((n, size), bool)
        marked[:, self.start] = True
        place, active, looked = np.zeros(n, np.int64), np.arange(n), n
        while len(active):
            at = place[active, None] + np.arange(STEP)
            inside = at < size
            at = np.minimum(at, size - 1)
            there = self.lists[entry[active, None], at]
            within = inside & (self.far[entry[active, None], at] <= 4 * best[active, None])
            fresh = within & ~marked[active[:, None], there]
            row, column = np.nonzero(fresh)
            looked += len(row)
            new = there[row, column]
            marked[active[row], new] = True
            apart = np.full(there.shape, np.iinfo(np.int64).max)
            apart[row, column] = ((points[active[row]] - self.entries[new]) ** 2).sum(axis=1)
            # The nearest of this block; among equals the lowest entry.
            least = apart.min(axis=1)
            lowest = np.where(apart == least[:, None], there, size).min(axis=1)
            better = (least < best[active]) | ((least == best[active]) & (lowest < entry[active]))
            jump = active[better]
            best[jump], entry[jump], place[jump] = least[better], lowest[better], 0
            stay = active[~better]
            place[stay] += STEP
            # A list ends where its entries end or lie beyond twice the current distance.
            going = np.ones(len(active), bool)
            going[~better] = within[~better].all(axis=1) & (place[stay] < size)
            active = active[going]
        return entry, best, looked


def assign(books: list[Book], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance of each part) for every row of a matrix."""
    parts = np.split(rows, len(books), axis=1)
    codes = np.zeros((len(rows), len(books)), np.int64)
    errors = np.zeros((len(rows), len(books)), np.int64)
    for p, (book, points) in enumerate(zip(books, parts)):
        for at in range(0, len(points), TOGETHER):
            codes[at : at + TOGETHER, p], errors[at : at + TOGETHER, p], _ = book.nearest(points[at : at + TOGETHER])
    return codes, errors


def _sums(rows: DataFrame, books: list[Book]) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts each entry has and the sums of their components."""
    wide = books[0].entries.shape[1]
    width, size = wide * len(books), len(books[0].entries)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books) * size, wide), np.int64)
        count = np.zeros(len(books) * size, np.int64)
        for batch in batches:
            rows = vectors.matrix(batch.column(0), width)
            codes, _ = assign(books, rows)
            at = (codes + np.arange(len(books)) * size).ravel()
            np.add.at(total, at, rows.reshape(-1, wide))
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(np.arange(0, len(used) * wide + 1, wide, dtype=np.int32), total[used].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // size).astype(np.int32)), pa.array((used % size).astype(np.int32)), pa.array(count[used]), lists],
            ["part", "entry", "n", "s"],
        )

    each = rows.select("v").mapInArrow(summed, "part int, entry int, n long, s array<long>")
    totals = [F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(wide)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Book]:
    """Books of a table with columns id and v (integer arrays of one length); none for an empty table."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()  # at most ``entries`` rows
    if not first.num_rows:
        return []
    width = len(first.column("v")[0])
    books = [Book.of(x) for x in np.split(vectors.matrix(first.column("v"), width), parts, axis=1)]
    for _ in range(rounds):
        new = [b.entries.copy() for b in books]
        for part, entry, n, *total in _sums(rows, books).collect():  # at most parts x entries rows
            new[part][entry] = np.array(total, np.int64) // n
        books = [Book.of(x) for x in new]
    return books


def books_digest(books: list[Book]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def encode(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a whole vector."""
    own = vectors.kept(rows, id_col, vector_col, F.col(label_col).alias("label"))
    own = settle(own.where(F.size("v") > 0), "vectors")
    least, most = own.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is not None and (least != most or least % parts):
        raise ValueError(f"vectors need one length that {parts} divides, not {least} to {most}")
    books = learn(own, parts, entries, rounds)
    label = own.schema["label"].dataType.simpleString()
    digits = max(2, len(f"{entries - 1:x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(books, vectors.matrix(batch.column(1), most))
            text = ["".join(f"{c:0{digits}x}" for c in own) for own in codes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(errors.sum(axis=1)), batch.column(2)],
                ["vec_id", "code", "error", "label"],
            )

    found = own.select("id", "v", "label").mapInArrow(coded, f"vec_id long, code string, error long, label {label}")
    found = settle(found, "codes")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("own_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
