"""Near-duplicates by SimHash fingerprints (operator 7).

Method: pigeonhole blocks. A fingerprint of 64 bits is cut into four blocks of 16; two
fingerprints that differ in at most two bits agree on two of the four blocks, so six
joins on 32-bit keys meet every close pair, and the Hamming distance is then checked.

Documents are first folded into distinct fingerprints, so copies never make pairs. A
key with more than ``CROWD`` fingerprints is cut again: the 32 bits left are eight
blocks of four, close fingerprints agree on six of them, and a group that agrees on
24 + 32 bits has at most 256 members whatever the data. Inside a group only a spanning
forest of the close pairs is emitted, so links grow with fingerprints, not with pairs,
and no link between different fingerprints is lost from the components.

Defined results: null and blank texts have fingerprint zero and are linked like any
other; a null id stays null and is never a component's id unless all ids are null;
repeated rows get a row each; an empty table gives no rows; other columns are not read; texts are
read whole, however long, their shingle hashes counted in slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import fresh, located, settle
from lagfield.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = 4
CROWD = 64
# Shingle hashes whose bits are counted at a time.
SLICE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the hashes of a text's word shingles, repeats included, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash_of(joined, seed)]
    else:
        ends = list(itertools.accumulate(map(len, words)))
        # The i-th word begins after the words before it and one space for each.
        hashes = [
            hash_of(joined[a:b], seed)
            for a, b in zip(
                [0, *(e + i + 1 for i, e in enumerate(ends[:-shingle]))],
                (e + i + shingle - 1 for i, e in enumerate(ends[shingle - 1 :])),
            )
        ]
    array = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(array), SLICE):
        part = array[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(array), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    return of(text)


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _joined(parts: list[Column], width: int) -> Column:
    key = parts[0]
    for p in parts[1:]:
        key = F.shiftleft(key, width).bitwiseOR(p)
    return key


def _forest(groups: DataFrame, distance: int) -> DataFrame:
    """(a, b): for each group's array ``fps``, links of close fingerprints that span what all close pairs span."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            column = batch.column(0)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            for begin, end in zip(offsets[:-1], offsets[1:]):
                own = values[begin:end]
                close = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= distance
                waiting = np.ones(len(own), bool)
                for root in range(len(own)):
                    if not waiting[root]:
                        continue
                    waiting[root] = False
                    reached = [root]
                    for x in reached:
                        new = np.flatnonzero(close[x] & waiting)
                        waiting[new] = False
                        reached.extend(new.tolist())
                        left.extend([own[x]] * len(new))
                        right.extend(own[new])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return groups.select("fps").mapInArrow(links, "a long, b long")


def close_links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among the distinct numbers ``fp`` that connect whatever pairs within ``distance`` (at most 2) do."""
    if not 0 <= distance <= BLOCKS - 2:
        raise ValueError(f"four blocks find pairs at up to two differing bits, not {distance}")
    block = [_bits(F.col("fp"), 16 * i, 16) for i in range(BLOCKS)]
    keys, rest = [], []
    for i, j in itertools.combinations(range(BLOCKS), 2):
        keys.append(F.struct(F.lit(6 * i + j).alias("t"), _joined([block[i], block[j]], 16).alias("key")))
        k, m = (x for x in range(BLOCKS) if x not in (i, j))
        rest.append((6 * i + j, _joined([block[k], block[m]], 16)))
    keyed = settle(fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key"), "blocks")
    sizes = keyed.groupBy("t", "key").count().where("count > 1")
    sized = keyed.join(sizes, ["t", "key"])
    small = sized.where(F.col("count") <= crowd).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    # In a crowd: the other 32 bits without two of their eight blocks of four.
    other = F.coalesce(*[F.when(F.col("t") == t, r) for t, r in rest])
    quarter = [_bits(F.col("other"), 4 * i, 4) for i in range(8)]
    finer = [
        F.struct(
            F.lit(8 * i + j).alias("s"),
            _joined([q for k, q in enumerate(quarter) if k not in (i, j)], 4).alias("sub"),
        )
        for i, j in itertools.combinations(range(8), 2)
    ]
    large = (
        sized.where(F.col("count") > crowd)
        .withColumn("other", other)
        .select("fp", "t", "key", F.explode(F.array(*finer)).alias("f"))
        .groupBy("t", "key", "f.s", "f.sub")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return _forest(small.select("fps").union(large.select("fps")), distance)


def roots(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``prints``; root is the component's smallest fingerprint."""
    own = settle(prints.select("fp").distinct(), "fingerprints")
    found = components(close_links(own, distance))
    return own.join(found, own.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (id, fp)."""
    named = prints.groupBy("fp").agg(F.min("id").alias("id")).join(roots(prints, distance), "fp")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest id reachable, for every row."""
    prints = settle(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    return prints.join(classes(prints, distance), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest id (nulls last), then the first stored."""
    file, row = fresh(docs, "at_file"), fresh(docs, "at_row")
    placed = located(docs, file, row)
    prints = settle(
        placed.select(
            F.col(id_col).alias("id"),
            fingerprint_column(F.col(text_col)).alias("fp"),
            F.col(file).alias("file"),
            F.col(row).alias("row"),
        ),
        "prints",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row"))
    best = prints.groupBy("fp").agg(first.alias("best")).join(roots(prints, distance), "fp")
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select("best.file", "best.row")
    return placed.join(kept, (placed[file] == kept.file) & (placed[row] == kept.row), "left_semi").select(*docs.columns)
