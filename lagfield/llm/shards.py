"""Weighted sharding by rendezvous hashing (operator 4).

Method: every shard draws a number for a row from a hash of the row's stable key and
the shard; the largest of ln(u) / weight wins. Only key, shard and weight decide, so one more
shard takes rows into itself alone, and a changed weight moves the share it has to.

Defined results: a null key is a key like any other; a null text has no bytes;
repeated rows go to the same shard and get slots of their own; an empty table gives no
rows; other columns are not read; sizes and checksums are of whole texts, however long.

Scale: shards are found row by row in the scan. Slots are numbered inside blocks that
are dealt at random, whatever the keys are, and shifted by running sums over the blocks, so no
window holds a shard's rows (one sums over its blocks: a row for each 20,000). The rows numbered are written once, since both passes must see
the same deal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfield.llm.common import settle

SHARDS = 40
ROW_BYTES = 16
BLOCK_ROWS = 20_000
# Hexadecimal digits of the md5 that make a number: 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: Column) -> Column:
    """Natural logarithm of a number between 0 and 1 that depends on key and shard only."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), shard.cast("string"))
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return F.ln((whole + 1) / float(16**DIGITS + 1))


def draws(key: Column, weights: Sequence[float]) -> Column:
    """Array of (draw / weight, shard) for shards 0 and up; the largest wins, ties go to the larger shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    shares = F.array(*(F.lit(float(w)) for w in weights))
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda i: F.struct((draw(key, i) / F.get(shares, i)).alias("score"), i.alias("shard")),
    )


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards."""
    return F.array_max(draws(key, weights))["shard"]


def number_slots(df: DataFrame, shard: str = "shard", order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``slot``: gapless from 0 inside each shard."""
    dealt = settle(df, "sharded")
    blocks = max(1, -(-dealt.count() // BLOCK_ROWS))
    dealt = settle(dealt.withColumn("block", F.floor(F.rand(7) * blocks)), "dealt")
    own = W.partitionBy(shard, "block").orderBy(*order or [shard])
    before = W.partitionBy(shard).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        dealt.groupBy(shard, "block")
        .count()
        .select(shard, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    return (
        dealt.withColumn("place", F.row_number().over(own) - 1)
        .join(sizes, [shard, "block"])
        .withColumn("slot", F.col("base") + F.col("place"))
        .drop("block", "base", "place")
    )


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    next_weight: float = 1.0,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and grown_shard once a shard of ``next_weight`` is added."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        draws(key, [*weights, next_weight]).alias("draws"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.array_max(F.slice("draws", 1, len(weights)))["shard"].alias("shard"),
        F.array_max("draws")["shard"].alias("grown_shard"),
    )
    return number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
