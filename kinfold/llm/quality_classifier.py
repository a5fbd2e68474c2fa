"""Operator 5, quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

The presence of each hashed byte or word n-gram is scaled by the log ratio of its smoothed rates in the
two classes; rows of these scaled indicators have unit length. A linear hinge-loss model is then fitted
by dual coordinate descent in numpy, on a bounded sample with about as many rows of either label, and
its margins become probabilities by a logistic curve fitted on rows kept out of the training.

Defined results: null and empty texts have no n-grams and get the probability of a zero row. With no
usable labels every score is 0.5. Repeated rows are scored one by one. Only ``doc_id`` and ``text`` are
read for a score, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf

SPEC = hf.FeatureSpec(
    (hf.Section("word", 1, 12), hf.Section("word", 2, 12), hf.Section("byte", 1, 8), hf.Section("byte", 2, 11), hf.Section("byte", 3, 13)),
    lower=False,
)
#: Labelled rows the model learns from, at most.
TRAIN_ROWS = 3000
#: Fixed threshold of the contract: from this probability on a row is predicted to have label 1.
THRESHOLD = 0.7


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


def log_count_ratio(at: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """log of the rate of each indicator among rows of label 1 against its rate among those of label 0."""
    counts = np.full((2, size), smooth)
    for a, y in zip(at, labels, strict=True):
        counts[int(y), a] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()]) + 2 * smooth
    return np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])


def dual_coordinate_descent(at: list[np.ndarray], value: list[np.ndarray], sign: np.ndarray, size: int, cost: np.ndarray, passes: int = 15) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss linear model; one dual variable for each row, within [0, its cost]."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(at))
    square = np.array([float(v @ v) + 1 for v in value])
    order = np.random.default_rng(5)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(at)):
            gradient = sign[i] * (float(w[at[i]] @ value[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at[i]] += step * value[i]
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _scaled(at: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    return [ratio[a] / max(float(np.sqrt((ratio[a] ** 2).sum())), 1e-9) for a in at]


def fit(docs: DataFrame, labels: DataFrame, learnable, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from at most ``train_rows`` labelled rows for which the Column ``learnable`` over doc_id holds."""
    known = labels.where(learnable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = hf.labelled_sample(known, train_rows)
    # The sample has train_rows rows at most: that bounds the broadcast.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found, at, _ = hf.collect_features(SPEC, rows, indicators=True)
    y = np.array(found, dtype=np.int64)
    held = hf.calibration_split(len(y))
    if not len(y) or any(len(set(y[m])) < 2 for m in (held, ~held)):
        return None
    own = [a for a, h in zip(at, held, strict=True) if not h]
    ratio = log_count_ratio(own, y[~held], SPEC.size)
    own_y = y[~held]
    cost = np.where(own_y == 1, 0.5 / own_y.mean(), 0.5 / (1 - own_y.mean()))
    w, bias = dual_coordinate_descent(own, _scaled(own, ratio), np.where(own_y == 1, 1.0, -1.0), SPEC.size, cost)
    margins = np.array([float(w[a] @ v) + bias for a, v in zip(at, _scaled(at, ratio), strict=True)])
    slope, offset = hf.platt(margins[held], y[held].astype(np.float64))
    return Model(ratio, w, bias, slope, offset)


def probabilities(model: Model, column: pa.Array) -> np.ndarray:
    """The calibrated probability of label 1 for each text."""
    out = np.zeros(len(column))
    weighted, squared = (model.weights * model.ratio).astype(np.float32), (model.ratio**2).astype(np.float32)
    for i, _, data, offsets in hf.text_pieces(SPEC, column):
        found = [(start, start + (1 << s.bits), *rest) for s, (start, *rest) in zip(SPEC.sections, hf.section_indexes(SPEC, data, offsets), strict=True)]
        there = np.zeros(SPEC.size, dtype=np.float32)
        for row in range(len(offsets) - 1):
            for start, stop, buckets, lo, hi in found:
                there[start:stop][buckets[lo[row] : max(lo[row], hi[row])]] = 1
            out[i + row] = float(there @ weighted) / max(float(np.sqrt(there @ squared)), 1e-9)
            there[:] = 0
    return 1 / (1 + np.exp(-np.clip((out + model.intercept) * model.slope + model.offset, -30, 30)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``."""
    runtime.ship_package(docs.sparkSession)
    key = hf.whole_ids(docs).schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            p = np.full(batch.num_rows, 0.5) if model is None else probabilities(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {key}, score double").withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
