"""Folds that the contracts fix: which rows are held out, and that nothing of them is learned."""

import zlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import hashed_features as hf
from kinfold.llm import quality_classifier, registry

SF = "/root/testdata/sf0.001"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name, modulus, rest", [("op2_language_id", 4, 2), ("op4_language_model", 10, 0), ("op5_quality_classifier", 4, 2)])
def test_held_out_rows(spark, name, modulus, rest):
    rows = registry.queries()[name](spark, SF).select("doc_id", "held_out").collect()
    assert len(rows) == 200 and {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if fold(r["doc_id"], modulus) == rest}


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = hf.crc_fold(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(labels).count() > 10
    first, second = (sorted(map(tuple, quality_classifier.score(docs, quality_classifier.fit(docs, own, F.col("doc_id").isNotNull() & ~held)).collect())) for own in (labels, turned))
    assert first == second
