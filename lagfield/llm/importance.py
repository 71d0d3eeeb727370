"""Importance resampling towards a target distribution (operator 13).

Method: hashed n-gram counts of the corpus and of the target give every bucket a gain, the
logarithm of how much likelier the target draws from it; a text's weight is the sum of its
features' gains, and adding Gumbel noise that the id alone decides and keeping the highest
scores draws without replacement in proportion to the weights.

Texts are handled by Arrow kernels: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode number the words of a batch; shifted indices form longer n-grams, only the
distinct ones are spelled out and hashed by CRC-32, ``take`` spreads the buckets over
the features, and segment sums give each text its weight.

Defined results: a null or blank text has no words, weight 0 and is never drawn with a
positive ``least_words``; words are runs of characters outside the ASCII ones that are neither digits nor
letters; ties in the score go to the smaller id (nulls last), then the first stored; a null id
draws its noise as an empty one; repeated rows count, and may be drawn, each for itself; an
empty table gives no rows, an empty target gives gains from no counts; other columns are not read;
a text is never cut, however long.

Scale: texts are read where they are, twice; a task emits one number a bucket, and gains are
``buckets`` numbers. Narrow rows are written once and dealt by ranges of the score, with the
place of the row as last key, so no value holds them together; ranks are places in these ranges
behind the sizes of the ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import fresh, located, settle

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Separators after A-Z became a-z: ASCII characters that are neither digits nor small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spelled(words: list[bytes], grams: np.ndarray) -> Iterator[bytes]:
    return (b" ".join(words[i] for i in gram) for gram in grams.tolist())


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length 1 to ``longest``: (features of each text, their buckets text by text, words of each text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat = pc.list_flatten(lists)
    own = pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "")  # the pieces before a leading and after a trailing separator are no words
    coded = flat.filter(full).dictionary_encode()
    own = own[full.to_numpy(zero_copy_only=False)]
    at, words = coded.indices.to_numpy().astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
    n_words = np.bincount(own, minlength=len(texts)).astype(np.int64)
    number = at  # of the n-gram that begins at each word, among the distinct ones
    distinct = np.arange(len(words), dtype=np.int64)[:, None]
    for length in range(1, longest + 1):
        if length > 1:
            # An n-gram is a shorter one and the word after it, both of one text.
            left = max(0, len(own) - length + 1)
            whole = own[length - 1 :] == own[:left]
            pair = number[:left] * len(words) + at[length - 1 :]
            pairs, place = np.unique(pair[whole], return_inverse=True)
            distinct = np.concatenate([distinct[pairs // max(1, len(words))], (pairs % max(1, len(words)))[:, None]], axis=1)
            number = np.zeros(len(whole), np.int64)
            number[whole] = place
        else:
            whole = np.ones(len(own), bool)
        hashed = np.fromiter(map(zlib.crc32, _spelled(words, distinct)), np.int64, len(distinct)) % buckets
        taken = pc.take(pa.array(hashed), pa.array(number[whole])).to_numpy() if len(distinct) else np.empty(0, np.int64)
        yield np.bincount(own[: len(whole)][whole], minlength=len(texts)).astype(np.int64), taken, n_words


def bucket_counts(rows: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, own, _ in features(batch.column(0), longest, buckets):
                total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    each = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in each.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, B buckets."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    of = {}  # one logarithm for each pair of counts
    for s, t in set(zip(corpus.tolist(), target.tolist())):
        of[s, t] = math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
    return np.array([of[x] for x in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of SHA-256 of ``seed:id``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST
) -> DataFrame:
    """(doc_id, file, row, n_words, n_features, weight) of every row, written once."""
    file, row = fresh(docs, "at_file"), fresh(docs, "at_row")
    kind = docs.schema[id_col].dataType.simpleString()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, n_words = 0, 0, None
            for own, taken, n_words in features(batch.column(0), longest, len(gain)):
                # A text's features follow one another; running totals give each its segment's sum.
                run = np.concatenate([[0], np.cumsum(gain[taken])])
                ends = np.cumsum(own)
                n, weight = n + own, weight + run[ends] - run[ends - own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *map(pa.array, (n_words, n, weight))],
                ["doc_id", "file", "row", "n_words", "n_features", "weight"],
            )

    wanted = located(docs, file, row).select(
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("doc_id"),
        F.col(file).alias("file"),
        F.col(row).alias("row"),
    )
    schema = f"doc_id {kind}, file string, row long, n_words long, n_features long, weight long"
    return settle(wanted.mapInArrow(weighed, schema), "weights")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, the number (from 1) of each in ``order``; written once, no range in one task.

    The keys should tell all rows apart, so that equal ones do not share a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = settle(dealt.withColumn("place", F.monotonically_increasing_id()), "ranges")
    ranged = stored.withColumn("range", F.shiftright("place", 33))
    sizes = ranged.groupBy("range").count().orderBy("range").collect()  # one row a range
    ahead = np.cumsum([1, *(r[1] for r in sizes)]).tolist()
    before = rows.sparkSession.createDataFrame([(r[0], n) for r, n in zip(sizes, ahead)], "range long, ahead long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "range").withColumn("place", inside + F.col("ahead")).drop("range", "ahead")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` is null where a row is not drawn."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    scored = weigh(docs, gain, id_col, text_col, longest)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = numbered(
        scored.withColumn("able", able),
        F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("file"), F.col("row"),
    )
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
