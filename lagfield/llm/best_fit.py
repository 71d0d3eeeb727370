"""Best-fit packing of token sequences (operator 3).

Method: bounded-space online best-fit. Pieces arrive one by one; each goes into the
open bin that it fills best, found in a bitset keyed by free space. At most
``open_bins`` bins are open; when another is needed, the fullest closes first.

Defined results: a null text counts as empty and is a document of the end id alone;
repeated rows are packed each for itself; a null id stays null; an empty table gives
no rows; columns other than the id and the text are not read. Only documents longer
than ``size`` are cut, however long they are, and none of their ids is lost.

Scale: ids are made where the text is read. Rows that describe pieces are dealt to
groups by a running number, so no key, source or copy makes a group large, and one
task packs one group. The number of groups grows with the bytes of text. Memory of a
packing task is one batch and ``open_bins`` numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lagfield.llm.common import text_groups
from lagfield.llm.tokens import encoder, vocabulary_path

SIZE = 4096
END_ID = 1
OPEN_BINS = 256
GROUP_BYTES = 16_000_000
VOCABULARY = "word_bpe_49k.json"


class BestFit:
    """Bins of ``size`` of which at most ``open_bins`` stay open."""

    def __init__(self, size: int = SIZE, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.with_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0  # bit f is set while some open bin has f free
        self.opened = self.open = 0

    def _take(self, free: int) -> int:
        bins = self.with_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(number of the bin, place in it) for a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.size, self.opened
            self.opened += 1
            self.open += 1
        left = free - length
        if left:
            self.with_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.size - free


def cut(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    with_ids: bool = True,
    kind_of_id: str = "<u4",
) -> DataFrame:
    """Pieces of at most ``size`` ids: doc id, piece, start, length, ids_crc32, turn, and the ids as bytes.

    ``turn`` numbers a task's pieces, scattered over the integers. ``ids`` are little-endian
    numbers of ``kind_of_id``, and one that does not fit is an error; ``with_ids=False``
    leaves them out. The checksum is always over unsigned 32-bit numbers.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    end, most = np.array([end_id], "<u4"), np.iinfo(kind_of_id).max
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "turn"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc, turns, ids = [], [], [], [], [], [], []
            for i, own in enumerate(encoder(path).encode_each(texts)):
                own = np.concatenate([own, end])
                if with_ids and own.max() > most:
                    raise ValueError(f"id {own.max()} does not fit {kind_of_id}")
                for k, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    turns.append((turn := turn + 1) * 2654435769 % 2**31)
                    if with_ids:
                        ids.append(own[at : at + size].astype(kind_of_id).tobytes())
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(turns, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, turn int" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, groups: int, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (with ``length`` and ``turn``) with sequence_id and offset added and turn removed.

    Each group is packed in the order of (turn, doc id, piece), which no rerun changes.
    """
    kept = [c for c in pieces.columns if c != "turn"]
    dealt = pieces.repartition(groups, "turn").sortWithinPartitions("turn", "doc_id", "piece").select(*kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([base + b for b, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                [*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    open_bins: int = OPEN_BINS,
    group_bytes: int = GROUP_BYTES,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Every document's ids cut and packed: one row per piece with its sequence and offset."""
    groups = text_groups(docs, text_col, group_bytes)
    pieces = cut(docs, id_col, text_col, size, vocabulary=vocabulary, with_ids=with_ids)
    return pack(pieces, groups, size, open_bins)
