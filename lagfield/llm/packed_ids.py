"""Packed token ids as binary rows (operator 9).

Method: best-fit-decreasing. The pieces of a group are placed longest first, each into
the bin with the least free space that still takes it, found by descending a segment
tree over capacities. Documents longer than a sequence are split without loss. Each
sequence becomes one row of the id matrix: ``size`` little-endian unsigned ids of 16 bits, or of 32 where
the vocabulary or the end id needs them, padded with the end id, with the cumulative lengths of its segments and the places where positions
start again.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each for itself;
a null id stays null; an empty table gives no rows; other columns are not read; a text of any length is
split into pieces, and nothing of it is lost.

Scale: as for operator 3, pieces are dealt to groups by a running number and a group holds about
``group_bytes`` of text whatever the data. A packing task holds the ids of one group.
Rows are written by Spark, so any file system it reaches will do, and a repeated task
writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm.best_fit import VOCABULARY, cut
from lagfield.llm.common import settle, text_groups
from lagfield.llm.tokens import encoder, vocabulary_path

SIZE = 2048
END_ID = 49407  # <|endoftext|> of the vocabulary
GROUP_BYTES = 16_000_000


class Capacities:
    """Bins keyed by free space; a segment tree counts the bins of each range of capacities."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        at = self.leaves + free
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free, number) of a bin with the least free space that is ``least`` or more, removed."""
        count, at = self.count, self.leaves + least
        if not count[at]:
            # Up to the first subtree further right that holds a bin, then down its left edge.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, place in it) for lengths of 1 to ``size`` that come in descending order."""
    capacities, placed, opened = Capacities(size), [], 0
    for length in lengths:
        found = capacities.take(length)
        if found is None:
            found, opened = (size, opened), opened + 1
        free, number = found
        placed.append((number, size - free))
        if free > length:
            capacities.add(free - length, number)
    return placed


def positions(cu_seqlens: list[int], size: int) -> np.ndarray:
    """Position of every token of a row: from 0 again at each segment, and in the padding."""
    edges = np.unique([*cu_seqlens, size])
    return np.arange(size) - np.repeat(edges[:-1], np.diff(edges))


def kind_of_id(vocabulary: str | None, end_id: int) -> str:
    """Numbers wide enough for every id of the vocabulary and the end id."""
    ids = encoder(vocabulary or vocabulary_path(VOCABULARY)).tokenizer.get_vocab(with_added_tokens=True).values()
    return "<u2" if max(end_id, *ids) < 1 << 16 else "<u4"


def pack_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row a sequence: sequence_id, ids, n_tokens, cu_seqlens, position_resets, doc_ids, pieces, starts."""
    number = kind_of_id(vocabulary, end_id)
    padding = np.array([end_id], number).tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    groups = text_groups(docs, text_col, group_bytes)
    pieces = cut(docs, id_col, text_col, size, end_id, vocabulary, kind_of_id=number)
    dealt = (
        pieces.repartition(groups, "turn")
        .sortWithinPartitions(F.desc("length"), "turn", "doc_id", "piece")
        .select("doc_id", "piece", "start", "length", "ids")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)  # one group
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = np.array(table["length"].to_pylist())
        placed = np.array(best_fit_decreasing(lengths.tolist(), size))
        order = np.lexsort((placed[:, 1], placed[:, 0]))
        edges = np.flatnonzero(np.diff(placed[order, 0], prepend=-1, append=-2))
        base = TaskContext.get().partitionId() << 32
        docs_of, piece_of, start_of = (table[c].combine_chunks() for c in ("doc_id", "piece", "start"))
        for at in range(0, len(edges) - 1, 512):
            own = edges[at : at + 513]
            members = pa.array(order[own[0] : own[-1]])
            offsets = pa.array((own - own[0]).astype(np.int32))
            ids = table["ids"].take(members).to_pylist()
            matrix, cumulative, resets, total = [], [], [], []
            for begin, end in zip(own[:-1] - own[0], own[1:] - own[0]):
                row = b"".join(ids[begin:end])
                cu = [0, *np.cumsum(lengths[order[own[0] + begin : own[0] + end]]).tolist()]
                matrix.append(row + padding * (size - cu[-1]))
                cumulative.append(cu)
                resets.append([*cu[:-1], *([cu[-1]] if cu[-1] < size else [])])
                total.append(cu[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(base + placed[order[own[:-1]], 0]),
                    pa.array(matrix, pa.binary()),
                    pa.array(total, pa.int32()),
                    pa.array(cumulative, pa.list_(pa.int32())),
                    pa.array(resets, pa.list_(pa.int32())),
                    *(pa.ListArray.from_arrays(offsets, c.take(members)) for c in (docs_of, piece_of, start_of)),
                ],
                ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"],
            )

    return dealt.mapInArrow(
        rows,
        "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>,"
        f" doc_ids array<{kind}>, pieces array<int>, starts array<long>",
    )


def write_packed(docs: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """The packed rows as Parquet at ``path`` (None: the shared folder), read back."""
    rows = pack_rows(docs, **settings)
    if path is None:
        return settle(rows, "packed")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def digest_rows(packed: DataFrame) -> DataFrame:
    """The rows with checksums in place of the id matrix, for comparing runs."""
    return packed.select(
        "sequence_id",
        "n_tokens",
        "doc_ids",
        "pieces",
        "starts",
        "cu_seqlens",
        "position_resets",
        F.crc32("ids").alias("ids_crc32"),
    )
