"""Windows, ordering, unions, sampling."""

from pyspark.sql import functions as F

from lagfield.catalog.base import query, with_obs
from lagfield.operators import cleaning as V
from lagfield.operators import sampling as P
from lagfield.sources.readers import union_all

RANKED = "SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS r FROM orders"


@query("w1_distributed_row_number", f"SELECT o_orderkey, r AS rank FROM ({RANKED})")
def _(t):
    return P.ranked(t.orders.select("o_orderkey"), "o_orderkey")


@query(
    "w1_row_number_per_group",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rank FROM orders",
)
def _(t):
    return P.ranked(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"])


@query(
    "w1_doubled_keys",
    "SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus"
    " ORDER BY md5('42|' || CASE WHEN o_orderkey % 3 = 0 THEN '7' ELSE CAST(o_custkey AS VARCHAR) END), o_custkey, o_orderkey) AS rank"
    " FROM orders",
)
def _(t):
    """A third of all rows has one key."""
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey")
    rows = rows.withColumn("key", F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey")))
    return P.ranked(rows, "key", ["o_orderstatus"]).drop("key")


@query("o1_sort_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def _(t):
    return t.events.select("event_id", "ts").orderBy("ts", "event_id")


@query("o2_head", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 3")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", "o_orderkey").limit(3)


@query(
    "u1_union_by_name",
    "SELECT l_orderkey AS okey, l_shipdate AS ts, l_extendedprice AS value FROM lineitem"
    " UNION ALL SELECT o_orderkey, o_orderdate, o_totalprice FROM orders UNION ALL SELECT event_id, ts, NULL FROM events",
)
def _(t):
    a = t.lineitem.selectExpr("l_orderkey AS okey", "l_shipdate AS ts", "l_extendedprice AS value")
    b = t.orders.selectExpr("o_totalprice AS value", "o_orderdate AS ts", "o_orderkey AS okey")
    c = t.events.selectExpr("ts", "event_id AS okey")
    return union_all([a, b, c])


@query(
    "u2_complement_by_predicate",
    with_obs("SELECT okey, line, part, XXLAT FROM obs WHERE NOT coalesce(XXLAT >= 0 AND XXLAT < 45, false)"),
)
def _(t):
    inside = (F.col("XXLAT") >= 0) & (F.col("XXLAT") < 45)
    return t.obs.where(~F.coalesce(inside, F.lit(False))).select("okey", "line", "part", "XXLAT")


@query(
    "p1_exact_size_split",
    f"SELECT o_orderkey, CASE WHEN r <= (SELECT count(*) // 7 FROM orders) THEN 'test' ELSE 'train' END AS side FROM ({RANKED})",
)
def _(t):
    df = t.orders.select("o_orderkey")
    test, train = P.split_exact(df, "o_orderkey", df.count() // 7)
    return test.withColumn("side", F.lit("test")).unionByName(train.withColumn("side", F.lit("train")))


@query("p2_sample_at_most", f"SELECT o_orderkey, o_totalprice FROM ({RANKED}) WHERE r <= 1000")
def _(t):
    return P.sample_at_most(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query(
    "p3_mixture_sampling",
    """WITH d AS (SELECT id AS draw, md5('42|draw|' || CAST(id AS VARCHAR)) AS h FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS id)),
       u AS (SELECT draw, CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 AS u1, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 AS u2 FROM d),
       p AS (SELECT o_orderkey, o_orderstatus AS source, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rank FROM orders),
       n AS (SELECT source, count(*) AS n FROM p GROUP BY 1),
       c AS (SELECT draw, u2, CASE WHEN u1 < 0.5 THEN 'F' WHEN u1 < 0.8 THEN 'O' ELSE 'P' END AS source FROM u)
       SELECT c.draw, c.source, p.rank, p.o_orderkey FROM c JOIN n USING (source)
       JOIN p ON p.source = c.source AND p.rank = CAST(floor(u2 * n) AS BIGINT) + 1""",
)
def _(t):
    part = lambda s: (s, t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey"))
    return P.mixture([part("F"), part("O"), part("P")], "o_orderkey", [0.5, 0.3, 0.2])


@query(
    "p4_epoch_shuffle",
    "SELECT o_orderkey, md5('3|' || CAST(o_orderkey AS VARCHAR)) AS position FROM orders",
)
def _(t):
    shuffled = P.epoch_shuffle(t.orders.select("o_orderkey"), "o_orderkey", 3)
    return shuffled.withColumn("position", P.hash_order("o_orderkey", 3))
