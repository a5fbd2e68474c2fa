"""Operator 10, mixing sources to target weights: a low-discrepancy schedule of slots, joined with equal-token blocks.

All steps are DataFrame expressions. The sources, in order of code point with null last, weigh 5, 2, 1 and
so on again, and share 1.5 times all words; a target stops at twice its source's words and the excess goes
to the others by weight. A slot is one block of words. Slot number n is the point frac((n + 1/2) g), g the
golden ratio, mapped through the cumulative shares of the sources, so each source's slots lie evenly in
the mix. Slots are ranked within their source; ranks beyond the source's quota drop out and the few that
the points leave short follow at the end. The documents of a source, shuffled by a hash of their ids, are
one stream of words, read twice over at most and cut into blocks of equal length; slot rank r takes block r.

Nothing unbounded meets in one task, whatever the number of sources and however often an id occurs: running sums and ranks are
taken in ranges of the order and of slot numbers, and the sums of these ranges are added up beforehand. Rows are
numbered, so even rows that are equal in all columns can be dealt to several ranges.

Defined results: null and blank texts have size 0 and are taken 0 times. Repeated rows are separate parts of the
stream. Ties of the hash are ordered by id and size. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import runtime
from kinfold.llm import hashed_features as hf
from kinfold.operators.ranking import running_sums

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE, MOST_PASSES = 1.5, 2
#: The golden ratio less one.
GOLDEN = 0.6180339887498949
#: Words of a block, at any size of the corpus.
BLOCK_WORDS = 1024
#: Rows that one running sum or ranking may take in.
GROUP_ROWS = 32768

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source and size of each row with its number: that of the column ``row``, or a new one, which holds once the table is written."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    return hf.whole_ids(docs).select("doc_id", number.alias(ROW), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def _weight(place: Column) -> Column:
    out = F.lit(WEIGHTS[-1])
    for k, w in enumerate(WEIGHTS[:-1]):
        out = F.when(place % len(WEIGHTS) == k, F.lit(w)).otherwise(out)
    return out.cast("double")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target and the whole words to take, one row for each source.

    The level at which targets stop is found in closed form: with sources ordered by cap over weight, the
    first one that stays below its cap when all before it are at theirs fixes the level of all that follow.
    """
    own = runtime.materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources", narrow=8)
    placed = running_sums(own, F.col("source").asc_nulls_last(), place=F.lit(1).cast("bigint"), offset=F.col("source_size"))
    placed = placed.withColumn("weight", _weight(F.col("place"))).withColumn("cap", (MOST_PASSES * F.col("source_size")).cast("double"))
    placed = runtime.materialize(placed.withColumn("ratio", F.col("cap") / F.col("weight")), "placed", narrow=8)
    ordered = running_sums(placed, "ratio", "place", caps=F.col("cap"), weights=F.col("weight"))
    totals = placed.agg((F.lit(SHARE) * F.sum("source_size")).alias("budget"), F.sum("weight").alias("all_weights"))
    leveled = ordered.crossJoin(totals).withColumn("level", (F.col("budget") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    # One row: the first source, in the order of their ratios, that stays below its cap.
    fixed = leveled.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place")).alias("fixed"))
    target = F.least(F.col("cap"), F.col("weight") * F.col("fixed"))
    found = leveled.crossJoin(fixed).withColumn("target", target)
    take = F.least(F.floor(F.col("target") + 0.5), MOST_PASSES * F.col("source_size"))
    return found.select("source", "place", "source_size", "offset", "target", take.alias("take"))


def schedule(goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """position, place and rank of every slot of the mix; rank is that of the block it takes from its source."""
    spark = goals.sparkSession
    quota = goals.select("place", F.ceil(F.col("take") / F.lit(float(block))).alias("quota")).where("quota > 0")
    bounds = running_sums(quota, "place", lo=F.col("quota")).withColumn("hi", F.col("lo") + F.col("quota"))
    row = bounds.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    n, cells = int(row["n"]), 4 * max(int(row["k"]), 1)
    # A source covers few cells of the unit interval; a slot looks in its own cell only.
    cell = lambda x: F.floor(x * F.lit(cells))
    spread = bounds.select("place", (F.col("lo") / F.lit(float(max(n, 1)))).alias("lo"), (F.col("hi") / F.lit(float(max(n, 1)))).alias("hi"))
    spread = spread.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    turn = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(n).withColumn("u", turn - F.floor(turn)).withColumn("cell", cell(F.col("u")))
    hit = points.join(spread, "cell").where("u >= lo AND u < hi").select("id", "place", F.floor(F.col("id") / GROUP_ROWS).alias("part"))
    counts = hit.groupBy("place", "part").agg(F.count("*").alias("c"))
    earlier = counts.withColumn("before", F.sum("c").over(Window.partitionBy("place").orderBy("part")) - F.col("c"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("place", "part").orderBy("id")) - 1
    numbered = hit.join(earlier.select("place", "part", "before"), ["place", "part"]).withColumn("rank", rank)
    kept = numbered.join(quota, "place").where("rank < quota").select(F.col("id").alias("position"), "place", "rank")
    had = quota.join(counts.groupBy("place").agg(F.sum("c").alias("had")), "place", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    short = had.where("had < quota").withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("quota") - 1)))
    return kept.union(short.select((F.lit(n) + F.col("rank")).alias("position"), "place", "rank"))


def streams(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` (with a number for each row) with the place of each document's first word in the shuffled stream of its source, and its source's goals."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    laid = running_sums(sized.withColumn("h", h), F.col("source").asc_nulls_last(), "h", "doc_id", "size", ROW, start=F.col("size"))
    named = goals.withColumnRenamed("source", "of")
    joined = laid.join(named, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("start", F.col("start") - F.col("offset")).drop("of", "h", "offset")


def mix(sized: DataFrame, goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix: position of the slot, row number, doc_id, source, start, size, first word and number of words taken there.

    A document that no slot takes has one row with a null position and no words.
    """
    laid = streams(sized, goals)
    read = laid.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1)))).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    # The first reading stays for documents that nothing takes.
    read = read.where("pass = 0 OR (from < take AND size > 0)")
    ranks = F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.greatest(F.col("size"), F.lit(1)) - 1) / block))
    cut = read.withColumn("rank", F.explode(ranks))
    lo = F.greatest(F.col("from"), F.col("rank") * block)
    hi = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * block, F.col("take"))
    words = F.when(F.col("position").isNotNull() & (hi > lo), hi - lo).otherwise(F.lit(0))
    joined = cut.join(schedule(goals, block), ["place", "rank"], "left")
    return joined.select("position", ROW, "doc_id", "source", "source_size", "target", "start", "size", (lo - F.col("from")).alias("first_word"), words.alias("words"))


#: The number of a row.
ROW = "_mix_row"


def with_taken(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target, taken and the first position in the mix for each row (null if nothing is taken).

    Columns of these names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "position")
    row = runtime.spare_name(docs, "mix_number")
    numbered = runtime.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _taken(sizes(numbered, row)).withColumnRenamed(ROW, row)
    return numbered.join(found.select(row, "size", "source_size", "target", "taken", "position"), row).drop(row)


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of ``docs``."""
    return _taken(sizes(docs)).drop("position", ROW)


def _taken(sized: DataFrame) -> DataFrame:
    sized = runtime.materialize(sized, "sizes")
    goals = runtime.materialize(targets(sized), "targets", narrow=8)
    parts = mix(sized, goals)
    first = F.min(F.when(F.col("words") > 0, F.col("position"))).alias("position")
    return parts.groupBy(ROW, "doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("taken"), first)


#: The same result in SQL, from the length that the mix takes of each source's stream.
SQL = r"""
WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, cast([5, 2, 1][1 + place % 3] AS DOUBLE) AS weight, cast(2 * source_size AS DOUBLE) AS cap FROM s),
v AS (SELECT *, cap / weight AS ratio, (1.5e0 * cast(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS fixed FROM v WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
g AS (SELECT source, source_size, least(cap, weight * fixed) AS target, least(cast(floor(least(cap, weight * fixed) + 0.5) AS BIGINT), 2 * source_size) AS take FROM v, f),
o AS (SELECT *, cast(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(cast(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM d)
SELECT doc_id, size, source_size, target, greatest(0, least(start + size, take) - start) + greatest(0, least(source_size + start + size, take) - source_size - start) AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""
