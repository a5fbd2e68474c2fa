"""Operator 9, quality rules: hard text statistics, then a calibrated hashed n-gram logistic regression.

The model is a logistic regression over hashed n-grams of words and of characters (code points), trained in numpy on a bounded
sample of labelled rows, calibrated on rows kept out of the training, and scored in Arrow batches
against a fixed threshold. All statistics and scores are taken over whole texts.

Defined results: a null text has no words and fails the base rules, as an empty one does. Repeated
rows are judged one by one. With no usable labels the model keeps what the base rules keep. Other
columns of the input are not read; clashing names cannot occur because only the key and the text are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.llm import textblocks as tb

SPEC = hf.FeatureSpec(
    (hf.Section("word", 1, 12), hf.Section("word", 2, 11), hf.Section("char", 1, 8), hf.Section("char", 2, 10), hf.Section("char", 3, 12)),
    lower=False,
)
#: Labelled rows the model learns from, at most.
TRAIN_ROWS = 3000
#: Fixed thresholds: base rules and the least calibrated probability of quality 1 that is kept.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_PROBABILITY = 0.5

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_LINE_END = np.zeros(256, dtype=bool)
_IS_LINE_END[10] = True

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double"


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float


def fit_logistic(at: list[np.ndarray], value: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = 30, batch: int = 64, penalty: float = 1e-5) -> np.ndarray:
    """Weights (the last is the intercept) by stochastic gradient steps with per-weight step sizes; classes weigh alike."""
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    w, seen, order = np.zeros(size + 1, dtype=np.float32), np.full(size + 1, 1e-8, dtype=np.float32), np.random.default_rng(9)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(at)), max(1, len(at) // batch)):
            x = hf.dense(at, value, part, size + 1)
            x[:, size] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (((p - labels[part]) * weight[part]).astype(np.float32)) / len(part) + penalty * w
            seen += g * g
            w -= 0.3 * g / np.sqrt(seen)
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from at most ``train_rows`` of the labelled documents; None if either label is missing."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = hf.labelled_sample(known, train_rows)
    # The sample has train_rows rows at most: that bounds the broadcast.
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found, at, value = hf.collect_features(SPEC, rows, indicators=False)
    y = np.array(found, dtype=np.float64)
    if len(set(found)) < 2 or min(y.sum(), (1 - y).sum()) < 6:
        return None
    held = hf.calibration_split(len(y))
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return None
    w = fit_logistic([a for a, h in zip(at, held, strict=True) if not h], [v for v, h in zip(value, held, strict=True) if not h], y[~held], SPEC.size)
    margins = np.array([float(v @ w[a]) + w[-1] for a, v in zip(at, value, strict=True)])
    slope, offset = hf.platt(margins[held], y[held])
    return Model(np.append(w[:-1], 0).astype(np.float64).reshape(-1, 1), slope, offset + slope * float(w[-1]))


def _repeats(values: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_statistics(column: pa.Array) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, one for each text."""
    all_data, all_offsets = tb.column_bytes(column)
    out = np.zeros((len(column), 5), dtype=np.int64)
    for i, j in tb.pieces(all_offsets):
        data, offsets = tb.piece_of(all_data, all_offsets, i, j)
        begins, ends, first = tb.word_bounds(data, offsets)
        out[i:j, 0] = np.diff(first)
        for k, counted in ((1, ~tb.IS_SPACE[data] & ((data & 0xC0) != 0x80)), (2, IS_SYMBOL[data])):
            sums = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(counted, out=sums[1:])
            out[i:j, k] = np.diff(sums[offsets])
        hashes = tb.span_hashes(data, begins, ends)
        triples = tb.window_hashes(hashes, 3)
        line_begins, line_ends, first_line = tb.word_bounds(data, offsets, _IS_LINE_END)
        lines = tb.span_hashes(data, line_begins, line_ends)
        worded = np.searchsorted(begins, line_ends) > np.searchsorted(begins, line_begins)
        for row in range(j - i):
            a, b = first[row], first[row + 1]
            if b - a >= 4:
                twice = _repeats(triples[a : b - 2])
                if twice.any():
                    covered = np.zeros(b - a, dtype=bool)
                    for k in range(3):
                        covered[k : k + len(twice)] |= twice
                    out[i + row, 4] = covered.sum()
            a, b = first_line[row], first_line[row + 1]
            if b - a >= 2:
                own = lines[a:b][worded[a:b]]
                out[i + row, 3] = len(own) - len(set(own.tolist()))
    return out


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each document: its statistics, base_failed, the model's probability and kept."""
    hf.whole_ids(docs)

    def score(batches):
        for batch in batches:
            text = batch.column("text")
            stats = text_statistics(text)
            if model is None:
                p = np.ones(len(text))
            else:
                p = 1 / (1 + np.exp(-np.clip(hf.mean_scores(SPEC, model.weights, text)[:, 0] * model.slope + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(stats[:, k]) for k in range(5)), pa.array(p)], schema=_ARROW)
        tb.release()

    runtime.ship_package(docs.sparkSession)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        docs.select("doc_id", "text")
        .mapInArrow(score, SCHEMA)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= MIN_PROBABILITY))
    )


_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("probability", pa.float64())])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The verdict is taken beside the row itself, so repeated ids need no join.
    """
    model = fit(docs, labels)
    runtime.ship_package(docs.sparkSession)
    schema = docs.schema

    def keep(batches):
        for batch in batches:
            text = batch.column("text")
            stats = text_statistics(text)
            good = (stats[:, 0] >= MIN_WORDS) & (100 * stats[:, 4] <= MAX_REPEAT_PERCENT * stats[:, 0])
            if model is not None:
                p = 1 / (1 + np.exp(-np.clip(hf.mean_scores(SPEC, model.weights, text)[:, 0] * model.slope + model.offset, -30, 30)))
                good &= p >= MIN_PROBABILITY
            yield batch.filter(pa.array(good))
        tb.release()

    return docs.mapInArrow(keep, schema)
