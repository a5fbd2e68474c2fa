"""The corpus pipeline: five stages from raw documents to a mix by source, each over all that its predecessor kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. What it returns is written as Parquet to the shared
folder and read again as the next stage's documents. All but the last return the columns of ``documents``; the
last adds what the mix takes of each, and its first position in the schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontamination, mixing, quality_rules, simhash_wide, substring_dedup
from kinfold.runtime import scratch_path, scratch_scope, table

#: Words of a shingle, and the similarity from which documents are near copies: the cosine of their sets of shingles, which SimHash stands for.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules or the model reject go.

    Null, empty and blank texts and those of fewer than 50 words are rejected. Equal rows are judged alike. Without usable labels only the rules count.
    An empty table stays empty, and other columns of any name pass through; that holds for all stages.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 at the similarity of near copies: of each group of linked documents the one with the smallest id stays.

    Null, empty and blank texts are one group. Of rows with the same smallest id one stays, whichever; a null id comes after all others.
    """
    return simhash_wide.keep_one(docs, SIMILARITY, SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: words go that lie in a passage of 13 words and more which a document with a smaller id has; no document goes.

    A text that loses nothing, null or blank ones included, stays byte for byte. Rows of one id don't take from each other, and a null id is larger than all others.
    """
    return substring_dedup.drop_repeats(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a passage of the benchmark go.

    Null, empty and blank texts stay. Equal rows are judged alike. An empty benchmark takes nothing.
    """
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents with their sizes, the target of their source, the words that the mix takes and where it first does.

    Null and blank texts have size 0 and are taken 0 times; a null source is one more source. Columns of the names that are added are replaced.
    """
    return mixing.with_taken(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixed),
]

#: SimHash and the trained rules have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; each but the last is written and read again, and what it needed on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
