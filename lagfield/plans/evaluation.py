"""A network from raw columns to reports: accuracy over splits, and scored grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.operators.bounded import settle
from lagfield.operators.histograms import shared_histogram
from lagfield.operators.keyed import pivot_cells
from lagfield.operators.statistics import accuracy_report
from lagfield.plans.scoring import assemble_array, preprocess, score_network
from lagfield.schema import BIN_WIDTH, TIME


def score_rows(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    means: dict[str, float],
    stds: dict[str, float],
    layers: Sequence[dict],
    width: int = BIN_WIDTH,
    precision: str = "float32",
) -> DataFrame:
    """``keep`` columns with predicted class, value, confidence and entropy: scale, assemble in
    list order, score. Kept columns come through as they were before scaling."""
    raw = df.withColumns({f"_keep_{c}": F.col(c) for c in keep})
    ready = preprocess(raw, means, stds, inputs)
    ready = ready.withColumn("_features", assemble_array(inputs, ready))
    kept = [f"_keep_{c}" for c in keep]
    scored = score_network(ready, "_features", layers, kept, width, precision=precision)
    return scored.withColumnsRenamed({f"_keep_{c}": c for c in keep})


def evaluate_network(
    df: DataFrame,
    inputs: Sequence[str],
    means: dict[str, float],
    stds: dict[str, float],
    layers: Sequence[dict],
    observed: str,
    split: str,
    reference: str,
    bins: int = 100,
    width: int = BIN_WIDTH,
    precision: str = "float32",
) -> tuple[DataFrame, DataFrame]:
    """(accuracy and mean entropy of each split, prediction-observation histogram over shared limits).

    Rows are scored once; what both tables read is written as four narrow columns."""
    scored = score_rows(df, [split, observed], inputs, means, stds, layers, width, precision)
    scored = settle(scored.select(split, observed, "predicted", "entropy"), "scored")
    return (
        accuracy_report(scored, observed, "predicted", [split], entropy="entropy"),
        shared_histogram(scored, observed, "predicted", split, reference, bins),
    )


def scored_grid(
    grid: DataFrame,
    inputs: Sequence[str],
    means: dict[str, float],
    stds: dict[str, float],
    layers: Sequence[dict],
    ts: str = TIME,
    altitude: str = "Altitude",
    width: int = BIN_WIDTH,
    precision: str = "float32",
) -> DataFrame:
    """(time, altitude, predicted, confidence) of every row of a time x altitude grid."""
    scored = score_rows(grid, [ts, altitude], inputs, means, stds, layers, width, precision)
    return scored.select(ts, altitude, "predicted", "confidence")


def grid_matrix(scored: DataFrame, value: str, altitudes: Sequence[float], ts: str = TIME, altitude: str = "Altitude") -> DataFrame:
    """One row a time, one column an altitude; a cell met twice is an error."""
    return pivot_cells(scored, ts, altitude, value, altitudes)
