"""Model scoring and training on the embedding table."""

from pyspark.sql import functions as F

from lagfield.catalog.base import query, rnd
from lagfield.functions.transforms import target_class
from lagfield.plans.scoring import fit_classes, score_classes, score_network

INPUTS, HIDDEN, CLASSES = 64, 8, 10


def small_network() -> list[dict]:
    """Integer-patterned weights, so that SQL can state the same network."""
    return [
        {
            "weight": [[(i * 7 + j * 3) % 5 - 2 for i in range(INPUTS)] for j in range(HIDDEN)],
            "bias": [j / 10 for j in range(HIDDEN)],
            "gamma": [1 + j / 8 for j in range(HIDDEN)],
            "beta": [j % 3 - 1 for j in range(HIDDEN)],
        },
        {
            "weight": [[(j * 5 + k * 2) % 7 - 3 for j in range(HIDDEN)] for k in range(CLASSES)],
            "bias": [k / 20 for k in range(CLASSES)],
        },
    ]


NETWORK_SQL = f"""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
h AS (SELECT vec_id, j, sum(x * ((i * 7 + j * 3) % 5 - 2)) + any_value(j) / 10e0 AS h FROM e CROSS JOIN (SELECT unnest(range({HIDDEN})) AS j) GROUP BY 1, 2),
n AS (SELECT vec_id, j, greatest(0, (h - avg(h) OVER w) / sqrt(var_pop(h) OVER w + 1e-5) * (1 + j / 8e0) + (j % 3 - 1)) AS a
      FROM h WINDOW w AS (PARTITION BY vec_id)),
z AS (SELECT vec_id, k, sum(a * ((j * 5 + k * 2) % 7 - 3)) + any_value(k) / 20e0 AS z FROM n CROSS JOIN (SELECT unnest(range({CLASSES})) AS k) GROUP BY 1, 2),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS ez FROM z),
q AS (SELECT *, ez / sum(ez) OVER (PARTITION BY vec_id) AS p, max(z) OVER (PARTITION BY vec_id) AS top FROM p)
SELECT vec_id, CAST(min(CASE WHEN z = top THEN k END) AS INTEGER) AS predicted_class,
  min(CASE WHEN z = top THEN k END) * 100e0 + 50 AS predicted,
  {rnd('max(p) * 100', 5)} AS confidence, {rnd('-sum(p * ln(p + 1e-10))', 5)} AS entropy FROM q GROUP BY 1
"""


def scored(t, network):
    """Scores in double precision, so that SQL gives the same digits."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = score_network(rows, "x", network, ["vec_id"], precision="float64")
    return out.withColumns({"confidence": F.round("confidence", 5), "entropy": F.round("entropy", 5)})


@query("k11_network_scoring", NETWORK_SQL)
def _(t):
    return scored(t, small_network())


SECOND = 6


def deeper_network() -> list[dict]:
    """The small network with a second hidden layer between."""
    first, last = small_network()
    middle = {
        "weight": [[(i * 3 + j * 4) % 7 - 3 for i in range(HIDDEN)] for j in range(SECOND)],
        "bias": [j / 4 - 0.5 for j in range(SECOND)],
        "gamma": [1 + j / 16 for j in range(SECOND)],
        "beta": [j % 2 / 2 for j in range(SECOND)],
    }
    return [first, middle, {"weight": [row[:SECOND] for row in last["weight"]], "bias": last["bias"]}]


DEEPER_SQL = NETWORK_SQL.replace(
    "z AS (SELECT vec_id, k, sum(a *",
    f"""h2 AS (SELECT vec_id, m AS j, sum(a * ((j * 3 + m * 4) % 7 - 3)) + (any_value(m) / 4e0 - 0.5) AS h
      FROM n CROSS JOIN (SELECT unnest(range({SECOND})) AS m) GROUP BY 1, 2),
n2 AS (SELECT vec_id, j, greatest(0, (h - avg(h) OVER w) / sqrt(var_pop(h) OVER w + 1e-5) * (1 + j / 16e0) + (j % 2) / 2e0) AS a
      FROM h2 WINDOW w AS (PARTITION BY vec_id)),
z AS (SELECT vec_id, k, sum(a *""",
).replace("FROM n CROSS JOIN (SELECT unnest(range(10))", "FROM n2 CROSS JOIN (SELECT unnest(range(10))")


@query("k11_two_hidden_layers", DEEPER_SQL)
def _(t):
    return scored(t, deeper_network())


# What training must bring about, row by row; rows with vec_id divisible by five are not learnt from.
@query(
    "k10_binned_regressor_training",
    "SELECT vec_id, CAST(greatest(0, least(9, floor((500 + 900 * (embedding[1]::DOUBLE + embedding[2]::DOUBLE)) / 100))) AS INTEGER) AS class,"
    " vec_id % 5 = 0 AS held_out, true AS class_in_range, true AS decoded_at_centre, true AS confidence_in_range,"
    " true AS beats_majority FROM embeddings",
)
def _(t):
    names = [f"x{i}" for i in range(INPUTS)]
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(names[i]) for i in range(INPUTS)]
    # The table's own labels do not depend on its vectors; a target that does can be learnt.
    df = t.embeddings.select("vec_id", *cols).withColumn("target", 500 + 900 * (F.col("x0") + F.col("x1")))
    df = df.withColumn("held_out", F.col("vec_id") % 5 == 0)
    model = fit_classes(df.where("NOT held_out"), names, "target", classes=CLASSES, hidden=(32,), iterations=60)
    out = score_classes(model, df).withColumn("class", target_class("target", classes=CLASSES))
    own = out.where("held_out").groupBy("class").agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted_class") == F.col("class")).alias("right")
    )
    best = own.agg((F.sum("right") > F.max("n")).alias("beats_majority"))  # one row
    return out.crossJoin(F.broadcast(best)).select(
        "vec_id",
        "class",
        "held_out",
        F.col("predicted_class").between(0, CLASSES - 1).alias("class_in_range"),
        (F.col("predicted") == F.col("predicted_class") * 100 + 50).alias("decoded_at_centre"),
        ((F.col("confidence") > 0) & (F.col("confidence") <= 100)).alias("confidence_in_range"),
        "beats_majority",
    )
