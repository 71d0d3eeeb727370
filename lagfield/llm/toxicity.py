"""Toxicity scores by FTRL-proximal logistic regression (operator 6).

Method: words, pairs of neighbours and pairs with one word between them are hashed to
2^20 coordinates, present or absent. FTRL-proximal learns a weight for each with a rate
of its own, and its L1 term keeps most at zero, so what is left is a few thousand
numbers at most, handed to the scoring tasks.

Training uses at most ``max_rows`` labelled rows (documented bound; those with the
smallest hash of their id). Their coordinates are found in parallel; one learner, which
FTRL is, then goes through them. Averaging several learners was tried and missed five
times as many toxic texts. Labels of held-out ids are never read. Scoring covers every
row and whole texts; only the text enters a score.

Defined results: a null or blank text scores by the bias alone; with no labelled row to
learn from every score is 0; an id labelled twice counts as toxic if any label says so;
null labels and null ids are left out of learning; repeated rows get a row each; an empty table gives
no rows; extra columns are not read; a text of any length is scored whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import held_out

BITS = 20
MAX_ROWS = 20_000


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4


@functools.cache
def _remembered() -> dict[bytes, int]:
    """Hashes of words this worker has seen."""
    return {}


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Coordinates, each once and in order, of a text's words, neighbours and pairs one word apart."""
    known = _remembered()
    if len(known) > 60_000:
        known.clear()
    words = []
    for word in (text or "").lower().encode().split():
        h = known.get(word)
        if h is None:
            h = known[word] = zlib.crc32(word.strip(b".,;:!?\"'()")) + 1
        words.append(h)
    h = np.array(words, np.uint64)
    mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2):
        mixed.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap)) ^ (h[gap:] * np.uint64(0x165667B19E3779F9)))
        mixed[-1] *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique((np.concatenate(mixed) >> np.uint64(64 - bits)).astype(np.int32))


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Learner:
    """FTRL-proximal state; coordinate 2^bits is the bias, which L1 does not touch."""

    def __init__(self, rates: Rates, bits: int = BITS):
        self.rates, self.bias = rates, 1 << bits
        self.z = np.zeros(self.bias + 1)
        self.n = np.zeros(self.bias + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        least = np.where(at == self.bias, 0.0, r.l1)
        w = (np.sign(z) * least - z) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)
        return np.where(np.abs(z) <= least, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        slope = sigmoid(w.sum()) - label
        root = np.sqrt(self.n[at])
        self.n[at] += slope * slope
        self.z[at] += slope - (np.sqrt(self.n[at]) - root) / self.rates.alpha * w


@dataclass
class Model:
    """Weights at sorted coordinates, and the bias; ``trained`` is false without labelled rows."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool = True
    bits: int = BITS

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        own = features(text, self.bits)
        if len(self.at) and len(own):
            place = np.minimum(np.searchsorted(self.at, own), len(self.at) - 1)
            return float(sigmoid(self.bias + self.weight[place][self.at[place] == own].sum()))
        return float(sigmoid(self.bias))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int
) -> DataFrame:
    """(id, text, label) of at most ``max_rows`` ids that are not held out."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col)).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # at most max_rows ids and labels
    # An id that many rows share is learnt from one of them.
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rates: Rates | None = None,
    max_rows: int = MAX_ROWS,
    bits: int = BITS,
) -> Model:
    """Weights learnt from the training rows; those at zero are not kept."""
    rates = rates or Rates()

    @F.pandas_udf("array<int>")
    def coordinates(texts):
        return texts.map(lambda t: features(t, bits))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []  # of at most max_rows texts
        for batch in batches:
            examples += zip([x.values.to_numpy() for x in batch.column(0)], batch.column(1).to_pylist())
        if not examples:
            return
        learner, order = Learner(rates, bits), np.random.default_rng(5)
        for _ in range(rates.epochs):
            for i in order.permutation(len(examples)):
                learner.learn(*examples[i])
        at = np.flatnonzero(learner.n)
        w = learner.weights(at)
        own = (w != 0) | (at == learner.bias)
        yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(w[own])], ["at", "weight"])

    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows)
    learnt = (
        rows.select("id", coordinates("text").alias("at"), "label")
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("id"), "id")
        .select("at", "label")
        .mapInArrow(learn, "at long, weight double")
        .toPandas()  # at most one row a coordinate: 2^bits + 1
        .sort_values("at")
    )
    inner = learnt[learnt["at"] < 1 << bits]
    bias = learnt["weight"][learnt["at"] == 1 << bits].sum()
    return Model(inner["at"].to_numpy(), inner["weight"].to_numpy(), float(bias), trained=len(learnt) > 0, bits=bits)


def score_column(text: Column, model: Model) -> Column:
    """Score of each text; the model travels with the function."""

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(model.score).astype("float64")

    return scored(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, **settings)
    scored = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(F.col(text_col), model).alias("score")
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic; every column as it was."""
    model = fit(docs, labels, id_col, text_col, **settings)
    return docs.where(score_column(F.col(text_col), model) < 0.5)
