"""Preprocessing for a model, distributed scoring, and training on Spark ML."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.functions import transforms as M
from lagfield.operators.cleaning import fill_zero, numeric_columns, to_number
from lagfield.schema import BIN_COUNT, BIN_WIDTH
from lagfield.session import scratch

# Bytes of a model that are shipped to executors without asking.
MODEL_BYTES = 2 << 30


def _group(name: str) -> str:
    head, _, tail = name.rpartition("_")
    return head if head and tail.isdigit() else name


def preprocess(
    df: DataFrame,
    means: dict[str, float],
    stds: dict[str, float],
    inputs: Sequence[str],
    fill: bool = True,
) -> DataFrame:
    """Scale position columns, z-score index columns by group (or by their own
    statistics), then turn what is still missing into zero.

    Index columns may be wide or lag arrays. The wide ones are SQL text in a single
    projection: hundreds of expressions built one by one are slow to plan.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in inputs if c in kinds]
    arrays = [c for c in present if isinstance(kinds[c], T.ArrayType)]
    number = set(numeric_columns(df))
    scaled = {
        c: M.SCALERS[c](F.col(c).cast("double") if c in number else to_number(c)) for c in present if c in M.SCALERS
    }
    scaled.update({c: M.z_score_array(c, means[c], stds[c]) for c in arrays if c in means and stds.get(c)})
    out = df.withColumns(scaled)
    if arrays and fill:
        out = fill_zero(out, arrays)

    def text(c: str) -> str:
        if c not in present or c in arrays:
            return f"`{c}`"
        e = f"`{c}`" if c in scaled or c in number else f"try_cast(`{c}` AS double)"
        name = _group(c) if _group(c) in means else c
        if c not in scaled and name in means and stds.get(name):
            e = f"({e} - {means[name]!r}D) / {stds[name]!r}D"
        return f"coalesce(nanvl({e}, 0D), 0D) AS `{c}`" if fill else f"{e} AS `{c}`"

    return out.selectExpr(*[text(c) for c in out.columns])


def normalize_by_column(
    df: DataFrame, means: dict[str, float], stds: dict[str, float], columns: Sequence[str], target: str | None = "Te1"
) -> DataFrame:
    """Per-column z-score, and optionally the logarithm of the target."""
    new = {c: M.z_score(F.col(c).cast("double"), means[c], stds[c]) for c in columns if c in df.columns}
    if target and target in df.columns:
        new[target] = F.ln(target)
    return df.withColumns(new)


def assemble_array(inputs: Sequence[str], df: DataFrame) -> Column:
    """Scalar and array inputs concatenated into one feature array, in list order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(
        *[
            F.col(c).cast("array<double>") if isinstance(kinds[c], T.ArrayType) else F.array(F.col(c).cast("double"))
            for c in inputs
        ]
    )


def class_outputs(df: DataFrame, scores: str, width: int = BIN_WIDTH) -> DataFrame:
    """Class, decoded value, confidence and entropy from class scores (logits)."""
    p = df.withColumn("_p", M.softmax(scores))
    return p.withColumns(
        {
            "predicted_class": M.best_class(scores),
            "predicted": M.class_centre(M.best_class(scores), width),
            "confidence": M.confidence("_p"),
            "entropy": M.entropy("_p"),
        }
    ).drop("_p")


def _ship(spark, layers: Sequence[dict], precision: str, most_bytes: int) -> tuple[str, list[dict]]:
    """(file name, for each layer the place and shape of its parts): all weights in one file at every executor.

    The file is written to the shared folder, and each executor fetches it once.
    """
    import numpy as np

    sized, at, item = [], 0, np.dtype(precision).itemsize
    for layer in layers:
        shapes = {name: np.shape(part) for name, part in layer.items()}
        own = {}
        for name, shape in shapes.items():
            own[name] = (at, shape)
            at += item * int(np.prod(shape))
        sized.append(own)
    if at > most_bytes:
        raise ValueError(f"the model takes {at} bytes in {precision}; raise most_bytes from {most_bytes} to ship it")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "weights"))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for layer in layers:
        for part in layer.values():
            flat = memoryview(np.ascontiguousarray(part, dtype=precision)).cast("B")
            for begin in range(0, len(flat), 1 << 24):
                out.write(bytearray(flat[begin : begin + (1 << 24)]))
    out.close()
    spark.sparkContext.addFile(str(path))
    return path.getName(), sized


@functools.cache
def _mapped(path: str):
    import numpy as np

    return np.memmap(path, mode="r")


def _network(name: str, sized: list[dict], precision: str) -> list[dict]:
    """The layers as views of the mapped file: pages that all workers of a host share, and no copy of a worker's own."""
    import numpy as np
    from pyspark import SparkFiles

    whole, item = _mapped(SparkFiles.get(name)), np.dtype(precision).itemsize
    part = lambda at, shape: whole[at : at + item * int(np.prod(shape))].view(precision).reshape(shape)
    return [{n: part(*place) for n, place in layer.items()} for layer in sized]


def score_network(
    df: DataFrame,
    features: str,
    layers: Sequence[dict],
    keep: Sequence[str] | None = None,
    width: int = BIN_WIDTH,
    with_scores: bool = False,
    precision: str = "float32",
    slice_rows: int = 512,
    most_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Score rows with a feed-forward network, ``slice_rows`` rows at a time.

    ``layers`` is a list of dicts with ``weight`` (out x in), ``bias`` and, for all
    but the last layer, ``gamma`` and ``beta`` of the layer normalisation that comes
    before the rectifier. They become one file of ``precision`` (4 bytes a parameter in float32: 339 MB
    for 84 million; more than ``most_bytes`` is refused) that executors fetch once and all their
    Python workers map, so the model is in memory once a host. Beside it a worker holds
    two activations of ``slice_rows`` x the widest layer (32 MB for 512 x 8192).
    Filter rows first: predicates do not pass through a Python stage. Adds class, decoded
    value, confidence and entropy (and scores); they are null where the features are null or one of them is
    null or NaN.
    """
    import numpy as np

    keep = list(keep if keep is not None else [c for c in df.columns if c != features])
    name, sized = _ship(df.sparkSession, layers, precision, most_bytes)
    source = df.select(*keep, F.col(features).alias("_x"))
    fields = [df.schema[c] for c in keep] + [
        T.StructField("predicted_class", T.IntegerType()),
        T.StructField("predicted", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
    ]
    if with_scores:
        fields.append(T.StructField("scores", T.ArrayType(T.DoubleType())))

    def logits(x, net):
        for layer in net[:-1]:
            x = x @ layer["weight"].T + layer["bias"]
            x -= x.mean(axis=1, keepdims=True)
            x /= np.sqrt((x * x).mean(axis=1, keepdims=True) + np.asarray(1e-5, precision))
            x *= layer["gamma"]
            x += layer["beta"]
            np.maximum(x, 0, out=x)
        return x @ net[-1]["weight"].T + net[-1]["bias"]

    def run(batches: Iterator):
        import pandas as pd

        net = _network(name, sized, precision)
        inputs = sized[0]["weight"][1][1]
        for whole in batches:
            for begin in range(0, len(whole), slice_rows):
                pdf = whole.iloc[begin : begin + slice_rows]
                out = pdf[keep].copy()
                x = np.stack([np.full(inputs, np.nan) if v is None else np.asarray(v, float) for v in pdf["_x"]])
                known = ~np.isnan(x).any(axis=1)
                z = logits(np.where(known[:, None], x, 0).astype(precision), net).astype("float64")
                e = np.exp(z - z.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                best = z.argmax(axis=1)
                found = {
                    "predicted_class": best.astype("int32"),
                    "predicted": best * float(width) + width // 2,
                    "confidence": p.max(axis=1) * 100.0,
                    "entropy": -(p * np.log(p + 1e-10)).sum(axis=1),
                }
                for column, values in found.items():
                    out[column] = pd.arrays.IntegerArray(values, ~known) if values.dtype.kind == "i" else pd.Series(
                        values, out.index, dtype="Float64"
                    ).mask(~known)
                if with_scores:
                    out["scores"] = [row if ok else None for row, ok in zip(z, known)]
                yield out

    return source.mapInPandas(run, T.StructType(fields))


def fit_classes(
    df: DataFrame,
    inputs: Sequence[str],
    target: str,
    classes: int = BIN_COUNT,
    width: int = BIN_WIDTH,
    hidden: Sequence[int] = (64,),
    iterations: int = 50,
    family: str = "network",
    seed: int = 42,
):
    """Train a regressor that predicts the class of the binned target.

    A Spark ML pipeline: assemble, then a multilayer perceptron (or multinomial
    logistic regression). Gradients are summed by tree aggregation over partitions,
    so training data stays where it is. A row without a target or with a missing input is an error, in
    training and in scoring: drop or fill such rows first (``guard_missing``, ``fill_zero``).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    unlabelled = F.raise_error(F.lit(f"a training row has no {target}")).cast("double")
    labelled = df.withColumn("label", F.coalesce(M.target_class(target, width, classes).cast("double"), unlabelled))
    assemble = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="error")
    if family == "network":
        model = MultilayerPerceptronClassifier(
            layers=[len(inputs), *hidden, classes], maxIter=iterations, seed=seed, blockSize=512
        )
    elif family == "logistic":
        model = LogisticRegression(maxIter=iterations, family="multinomial")
    else:
        raise ValueError(f"unknown family {family!r}")
    return Pipeline(stages=[assemble, model]).fit(labelled)


def score_classes(model, df: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Apply a trained pipeline; class, decoded value, confidence and entropy per row."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return scored.withColumns(
        {
            "predicted_class": F.col("prediction").cast("int"),
            "predicted": M.class_centre(F.col("prediction"), width),
            "confidence": M.confidence("_p"),
            "entropy": M.entropy("_p"),
        }
    ).drop("_p", "rawPrediction", "probability", "prediction", "features")
