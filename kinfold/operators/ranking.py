"""Places and running sums in a total order of a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import runtime

_OFFSET_BITS = 33


def _ranges(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` sorted within ranges, with the range (_part) and the place in it (_at).

    The ranges come from samples and may differ from run to run, so the numbered rows are written once and all uses read the same.
    """
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id())
    numbered = held.withColumns({"_part": F.shiftright("_mono", _OFFSET_BITS), "_at": F.col("_mono").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))})
    return runtime.materialize(numbered.drop("_mono"), "ranked")


def _before(sums: DataFrame, *names: str) -> DataFrame:
    """Of each range, the sums over all ranges before it. One row for each range: bounded by the number of partitions."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names)))


def ranked(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place in the order, from 0; the order should be total."""
    held = _ranges(rows, *order)
    sizes = held.groupBy("_part").agg(F.count("*").alias("n"))
    return held.join(_before(sizes, "n"), "_part").withColumn(name, F.col("_before_n") + F.col("_at")).drop("_part", "_at", "_before_n")


#: Rows of a small table that one task may sort.
ONE_TASK_ROWS = 32768


def running_sums(rows: DataFrame, *order: Column | str, one_task_rows: int = ONE_TASK_ROWS, **sums: Column) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows before, 0 for the first, under its name; the order should be total.

    A table of at most ``one_task_rows`` is one window. In a larger one each range is summed up by itself, and the ranges' own sums are
    added beforehand.
    """
    if rows.limit(one_task_rows + 1).count() <= one_task_rows:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    held = _ranges(rows.withColumns({f"_own_{n}": c for n, c in sums.items()}), *order)
    totals = held.groupBy("_part").agg(*(F.sum(f"_own_{n}").alias(n) for n in sums))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = held.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)) for n in sums})
    placed = within.join(_before(totals, *sums), "_part").withColumns({n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in sums})
    return placed.drop("_part", "_at", *(f"{p}_{n}" for n in sums for p in ("_own", "_in", "_before")))


def bursts(rows: DataFrame, time: str, gap: Column, name: str = "burst") -> DataFrame:
    """The times of ``rows`` with the number of their burst: a time more than ``gap`` after the one before begins a new one.

    A range of times looks at the last time before it, and the bursts that begin in each range are added up beforehand.
    """
    held = _ranges(rows.select(time), time)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = held.groupBy("_part").agg(F.max(time).alias("_top"))
    last = F.broadcast(tops.select("_part", F.max("_top").over(earlier).alias("_last")))
    inside = Window.partitionBy("_part").orderBy("_at")
    before = F.coalesce(F.lag(time).over(inside), F.col("_last"))
    marked = held.join(last, "_part").withColumn("_new", F.when(F.col(time) <= before + gap, 0).otherwise(1))
    counted = marked.withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = marked.groupBy("_part").agg(F.sum("_new").alias("n"))
    return counted.join(_before(totals, "n"), "_part").select(time, (F.col("_before_n") + F.col("_in")).alias(name))


def running_max(rows: DataFrame, value: Column, *order: Column | str, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` among all rows up to and with each, nulls left out, under ``name``; the order should be total.

    Each range is gone through by itself, and the largest values of the ranges are carried on beforehand.
    """
    held = _ranges(rows.withColumn("_own", value), *order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = held.groupBy("_part").agg(F.max("_own").alias("_top"))
    before = F.broadcast(tops.select("_part", F.max("_top").over(earlier).alias("_before")))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = held.withColumn("_in", F.max("_own").over(inside)).join(before, "_part")
    return joined.withColumn(name, F.greatest("_in", "_before")).drop("_part", "_at", "_own", "_in", "_before")
