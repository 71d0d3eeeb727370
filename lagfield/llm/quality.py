"""Quality rules on compressed size (operator 10).

Method: compression bands. A text's zstandard ratio (bytes in per byte out), as a whole
and chunk by chunk at several sizes, has to lie in a band that depends on the length:
short texts compress little whatever they say, long ones have more to repeat. Above the
band a text is repetitive, below it incompressible. The last chunk of a size ends with the
text, so every byte is in one. A few odd chunks are no verdict; a share of them, at any
size, is, and the share is less for longer texts.

Base counts go with it: words, their code points, symbols, lines equal to an earlier
line, and words inside three-word windows that occur twice or more.

Defined results: null and blank texts have no words and fail the base rule; repeated
rows get a row each; an empty table gives no rows; other columns are not read. Each row
is judged alone, in the task that reads it, in memory of the text's size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

LEVEL = 3
#: (bytes from, least ratio, most ratio) of whole texts, by their length.
BANDS = ((0, 0.0, 3.0), (256, 1.05, 3.0), (1024, 1.2, 3.5), (4096, 1.3, 4.0), (65536, 1.3, 5.0))
#: (texts from, texts below, bytes of a chunk, least ratio, most ratio) of chunks.
CHUNKS = ((0, 512, 128, 1.0, 1.8), (512, None, 256, 1.1, 2.2), (2048, None, 1024, 1.3, 3.0), (4096, None, 4096, 1.3, 4.0))
#: (bytes from, share of chunks outside their band that a text may have), by the text's length.
ODD_SHARES = ((0, 0.25), (4096, 0.15), (65536, 0.05))
# Fixed values of the base rule.
SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANKS = " \t\n\v\f\r"
MIN_WORDS = 50


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(number) + ids[2:]  # below words squared: exact
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> dict[str, int]:
    words = text.encode().split()  # bytes are split at the space and at 9 to 13
    lines = Counter(text.split("\n"))
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(BLANKS)),
        "n_repeat_words": repeated_words(words),
    }


class Bands:
    """Compression verdicts; one compressor for each worker."""

    def __init__(self, bands=BANDS, chunks=CHUNKS, odd_shares=ODD_SHARES, level=LEVEL):
        self.bands, self.chunks, self.odd_shares = bands, chunks, odd_shares
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.compress(data)) if data else 1.0

    def judge(self, text: str) -> tuple[float, int, int, bool]:
        """(ratio of the whole, chunks of all sizes, chunks outside their band, kept)."""
        data = text.encode()
        whole, length = self.ratio(data), len(data)
        _, least, most = [b for b in self.bands if b[0] <= length][-1]
        share = [b[1] for b in self.odd_shares if b[0] <= length][-1]
        good, total, odd = least <= whole <= most, 0, 0
        for begin, end, size, low, high in self.chunks:
            if length < begin or end is not None and length >= end:
                continue
            starts = [*range(0, length - size, size), max(0, length - size)]
            outside = sum(not low <= self.ratio(data[i : i + size]) <= high for i in starts)
            good = good and outside <= share * len(starts)
            total, odd = total + len(starts), odd + outside
        return whole, total, odd, good


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, ratio double, n_chunks long, n_odd_chunks long"
)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Base counts and the compression verdict of every row; ``limits`` as for ``Bands``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(p.split()[0] for p in SCHEMA.split(", "))]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(**limits)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_counts(text)
                failed = base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > 50 * base["n_words"]
                ratio, chunks, odd, good = bands.judge(text)
                rows.append((*base.values(), failed, good and not failed, ratio, chunks, odd))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names)

    return docs.select(id_col, text_col).mapInArrow(judged, f"doc_id {kind}, {SCHEMA}")
