"""Operator 2, language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its hashed byte 2- to 4-grams (A-Z lower-cased), and a
linear softmax maps that mean to a language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample, about as many texts of each language. A
third of the sample is kept out: half of that fits the softmax temperature, the other half the score from which on a
prediction is accepted. Whole texts are scored in Arrow batches.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not accepted. With
no learnable row every text is ``und``. Repeated rows are scored one by one; empty tables give empty
results. Only ``doc_id`` and ``text`` are read for a prediction, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf

SPEC = hf.FeatureSpec((hf.Section("byte", 2, 11), hf.Section("byte", 3, 12), hf.Section("byte", 4, 12)), lower=True)
#: Texts the model learns from, at most, over all languages, unless these are so many that 16 texts of each are more.
TRAIN_ROWS = 2400
DIMENSIONS = 16
UNKNOWN = "und"
#: The accepted part of the calibration rows must be right at this rate.
ACCEPTED_PRECISION = 0.99


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(at: list[np.ndarray], value: list[np.ndarray], target: np.ndarray, classes: int, epochs: int = 12, batch: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases by SGD with step sizes that shrink with past gradients."""
    order = np.random.default_rng(2)
    e = order.normal(0, 0.3, (SPEC.size, DIMENSIONS)).astype(np.float32)
    o = order.normal(0, 0.3, (DIMENSIONS, classes)).astype(np.float32)
    b = np.zeros(classes, dtype=np.float32)
    seen = [np.full_like(x, 1e-8) for x in (e, o, b)]
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(at)), max(1, len(at) // batch)):
            x = hf.dense(at, value, part, SPEC.size)
            hidden = x @ e
            d = softmax(hidden @ o + b).astype(np.float32)
            d[np.arange(len(part)), target[part]] -= 1
            d /= len(part)
            for w, g, s in zip((e, o, b), (x.T @ (d @ o.T), hidden.T @ d, d.sum(axis=0)), seen, strict=True):
                s += g * g
                w -= 0.2 * g / np.sqrt(s)
    return e, o, b


def fit(docs: DataFrame, learnable, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from at most ``train_rows`` rows, or 16 of each language where that is more, for which the Column ``learnable`` holds; None if there are none."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"), "text")
    chosen = hf.sample_of_all_labels(known.select("doc_id", "label"), train_rows)
    # The sample has train_rows rows, or some for each language: that bounds the broadcast. Repeated ids give one row for each language.
    rows = known.join(F.broadcast(chosen.distinct()), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found, at, value = hf.collect_features(SPEC, rows, indicators=False)
    if not found:
        return None
    languages = sorted(set(found))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in found])
    held = hf.calibration_split(len(y)) if len(y) >= 30 else np.zeros(len(y), dtype=bool)
    # The three sections' frequencies sum to 3; the factor keeps hidden values near 1.
    value = [v * np.float32(8) for v in value]
    own, rest = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    e, o, b = train([at[i] for i in own], [value[i] for i in own], y[own], len(languages))
    z, target = np.array([(value[i] @ e[at[i]]) @ o + b for i in rest]), y[rest]
    fits = slice(0, None, 2) if len(rest) >= 20 else slice(None)
    temperature = min(np.geomspace(0.2, 5, 41), key=lambda t: -np.log(softmax(z[fits] * t)[np.arange(len(target[fits])), target[fits]] + 1e-12).mean())
    if len(rest) >= 20:
        z, target = z[1::2], target[1::2]
    p = softmax(z * temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == target
    order = np.argsort(-score)
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(rate >= ACCEPTED_PRECISION)
    least = float(score[order[enough[-1]]]) if len(enough) else 1.0
    return Model(languages, e.astype(np.float64) * 8, o.astype(np.float64), b.astype(np.float64), float(temperature), least)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each row of ``docs``."""
    runtime.ship_package(docs.sparkSession)
    key = hf.whole_ids(docs).schema["doc_id"].dataType.simpleString()
    # With few languages it is cheaper to fold the output layer into the embeddings.
    folded = None if model is None else (model.embeddings @ model.output if len(model.languages) <= DIMENSIONS else model.embeddings)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            if model is None:
                best, top = np.array([UNKNOWN] * n, dtype=object), np.zeros(n)
            else:
                z = hf.mean_scores(SPEC, folded, batch.column("text"))
                if len(model.languages) > DIMENSIONS:
                    z = z @ model.output
                p = softmax((z + model.bias) * model.temperature)
                best, top = np.array(model.languages, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lettered"), pa.array(best, pa.string()), pa.array(top)], names=["doc_id", "lettered", "best", "top"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(score, f"doc_id {key}, lettered boolean, best string, top double")
    usable = F.col("lettered") & F.lit(model is not None)
    return found.select(
        "doc_id",
        F.when(usable, F.col("best")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(usable, F.col("top")).otherwise(F.lit(0.0)).alias("score"),
        (usable & (F.col("top") >= F.lit(1.0 if model is None else model.least_score))).alias("accepted"),
    )
