"""Hashed n-gram features of whole texts and the bounded, labelled sample that the classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import runtime
from kinfold.llm import textblocks as tb


@dataclass(frozen=True)
class Section:
    """One family of n-grams: ``width`` consecutive bytes, characters (code points) or words, hashed into 2**bits buckets."""

    kind: str
    width: int
    bits: int


@dataclass(frozen=True)
class FeatureSpec:
    sections: tuple[Section, ...]
    lower: bool

    @property
    def size(self) -> int:
        return sum(1 << s.bits for s in self.sections)

    def starts(self) -> list[int]:
        return np.cumsum([0, *(1 << s.bits for s in self.sections)]).tolist()


def section_indexes(spec: FeatureSpec, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each section: its first feature, the bucket of every n-gram, and the range of n-grams of each row.

    An n-gram lies in one row: those that would reach into the next row are outside every range.
    """
    words = points = None
    for number, (section, start) in enumerate(zip(spec.sections, spec.starts(), strict=False)):
        if section.kind == "byte":
            buckets, bounds = tb.gram_indexes(data, section.width, section.bits, number + 1), offsets
        elif section.kind == "char":
            if points is None:
                points = tb.code_points(data, offsets)
            buckets, bounds = tb.point_gram_indexes(points[0], section.width, section.bits, number + 1), points[1]
        else:
            if words is None:
                begins, ends, first = tb.word_bounds(data, offsets)
                words = tb.span_hashes(data, begins, ends), first
            grams = tb.window_hashes(words[0], section.width)
            buckets, bounds = (grams >> np.uint64(64 - section.bits)).astype(np.int64), words[1]
        lo = bounds[:-1]
        yield start, buckets, lo, np.maximum(lo, bounds[1:] - (section.width - 1))


def text_pieces(spec: FeatureSpec, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tb.column_bytes(column)
    for i, j in tb.pieces(offsets):
        part, bounds = tb.piece_of(data, offsets, i, j)
        yield i, j, (tb.translate(part, tb.LOWER) if spec.lower else part), bounds


def mean_scores(spec: FeatureSpec, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """For each text and each column of ``weights``: the sum over sections of the mean weight of its n-grams."""
    out = np.zeros((len(column), weights.shape[1]))
    for i, j, data, offsets in text_pieces(spec, column):
        for start, buckets, lo, hi in section_indexes(spec, data, offsets):
            count = np.maximum(hi - lo, 1)
            for k in range(weights.shape[1]):
                sums = np.zeros(len(buckets) + 1)
                np.cumsum(weights[start : start + (1 << 31), k][buckets], out=sums[1:])
                lo_, hi_ = np.minimum(lo, len(buckets)), np.minimum(hi, len(buckets))
                out[i:j, k] += (sums[np.maximum(lo_, hi_)] - sums[lo_]) / count
    return out


def frequency_rows(spec: FeatureSpec, column: pa.Array, indicators: bool) -> Iterator[tuple[bytes, bytes]]:
    """The non-zero features of each text: int32 positions and float32 values.

    A value is the share of its section's n-grams, or 1 where only presence counts.
    """
    for _, _, data, offsets in text_pieces(spec, column):
        found = list(section_indexes(spec, data, offsets))
        for row in range(len(offsets) - 1):
            at, value = [], []
            for start, buckets, lo, hi in found:
                part = buckets[lo[row] : max(lo[row], hi[row])]
                if len(part):
                    counts = np.bincount(part)
                    there = np.flatnonzero(counts)
                    at.append(there + start)
                    value.append(np.ones(len(there)) if indicators else counts[there] / len(part))
            yield (
                np.concatenate(at).astype(np.int32).tobytes() if at else b"",
                np.concatenate(value).astype(np.float32).tobytes() if value else b"",
            )


def whole_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` if its ids are whole numbers, as all operators here take them; an error at once if they are not."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")
    return df


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


#: Labels that are told apart, at most: the most frequent ones.
MOST_LABELS = 256


def labelled_sample(rows: DataFrame, limit: int, most_labels: int = MOST_LABELS) -> DataFrame:
    """At most ``limit`` of the rows (doc_id, label), about as many of each of the ``most_labels`` most frequent labels.

    The chosen rows depend on ids and labels alone. One narrow aggregate counts the labels; the
    sample is then a filter and a bounded top-k, so nothing unbounded reaches one task or the driver.
    """
    most = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels)
    counts = {r["label"]: r["n"] for r in most.collect()}
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(limit / len(counts) / n)).otherwise(share)
    u = uniform(F.col("doc_id"), F.lit("sample"))
    return rows.where(u < share).orderBy(u, "doc_id", "label").limit(limit)


#: Rows of each label that a sample of all labels has, where there are as many.
LEAST_ROWS = 16


def sample_of_all_labels(rows: DataFrame, limit: int, least: int = LEAST_ROWS) -> DataFrame:
    """Like ``labelled_sample``, but of every label: some ``least`` rows of each however many labels there are, and at most ``limit`` rows or twice as many as that takes."""
    counts = runtime.materialize(rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n")), "labels", narrow=8)
    labels = counts.count()
    if not labels:
        return rows.limit(0)
    u = uniform(F.col("doc_id"), F.lit("sample"))
    share = F.lit(max(limit / labels, float(least))) / F.col("n")
    shares = runtime.if_small(counts.select("label", share.alias("_share")), labels)
    return rows.join(shares, "label").where(u < F.col("_share")).select(*rows.columns).orderBy(u, "doc_id", "label").limit(max(limit, 2 * least * labels))


def collect_features(spec: FeatureSpec, rows: DataFrame, indicators: bool) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
    """Labels and sparse features of the bounded sample ``rows`` (doc_id, label, text), in an order of its own."""

    def featurize(batches):
        for batch in batches:
            pairs = list(frequency_rows(spec, batch.column("text"), indicators))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
                names=["doc_id", "label", "at", "value"],
            )

    runtime.ship_package(rows.sparkSession)
    kind = rows.schema["label"].dataType.simpleString()
    key = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "label", "text").mapInArrow(featurize, f"doc_id {key}, label {kind}, at binary, value binary").collect()
    found.sort(key=lambda r: (str(r["doc_id"]), str(r["label"]), bytes(r["at"])))
    return (
        [r["label"] for r in found],
        [np.frombuffer(r["at"], dtype=np.int32) for r in found],
        [np.frombuffer(r["value"], dtype=np.float32) for r in found],
    )


def dense(at: list[np.ndarray], value: list[np.ndarray], which: np.ndarray, size: int) -> np.ndarray:
    """The rows ``which`` of the sparse features, as a dense float32 matrix."""
    out = np.zeros((len(which), size), dtype=np.float32)
    for k, i in enumerate(which.tolist()):
        out[k, at[i]] = value[i]
    return out


def calibration_split(n: int, parts: int = 3) -> np.ndarray:
    """True for every ``parts``-th row: those calibrate, the others train. With few rows all do both."""
    return np.arange(n) % parts == parts - 1


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns margins into probabilities, by Newton steps with smoothed targets."""
    positives, negatives = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)
