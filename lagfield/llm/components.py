"""Connected components of links between numbers, by alternating star contraction.

The large-star and small-star steps of Kiveris et al. (2014): each step is one
aggregation and one join on the links, the number of rounds grows with the logarithm
of the longest chain, and no group of links is ever gathered in one place: the links of
a node are dealt out in ``SHARES`` shares, each share learns its smallest neighbour, and the
shares' few rows tell each other the node's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfield.llm.common import discard, settle


# Shares into which the links of every node are dealt.
SHARES = 64


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``links`` (a, b) with ``m``, the smallest b of each a; (a, m), at most ``SHARES`` times a node)."""
    dealt = links.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SHARES)).alias("share"))
    shares = dealt.groupBy("a", "share").agg(F.min("b").alias("own"))
    shares = shares.select("a", "share", F.min("own").over(W.partitionBy("a")).alias("m"))
    return dealt.join(shares, ["a", "share"]).select("a", "b", "m"), shares.select("a", "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both)[0].where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    near, ends = _with_least(links)
    moved = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(ends.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: numbers); root is the smallest node reachable.

    Each round is written to the shared folder and its predecessor removed; the rounds
    end when one changes nothing.
    """
    now = settle(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    state = _state(now)
    while True:
        after = settle(_small_star(_large_star(now)), "links")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(links: DataFrame):
    """Count and two order-free checksums of the links, equal only when nothing changed."""
    return tuple(
        links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
    )
