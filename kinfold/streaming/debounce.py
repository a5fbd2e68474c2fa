"""Bursts of directory events as sessions: one trigger for each burst, when it has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinfold import constants as C
from kinfold import runtime
from kinfold.operators.ranking import bursts, running_max


def debounce_stream(events: DataFrame, seconds: int = C.DEBOUNCE_SECONDS) -> DataFrame:
    """(started, fires_at, events) of each burst of a stream with an event time ``ts``, emitted once it is over.

    One timer serves all directories, so all events share one key. The watermark only says when a burst is over.
    """
    gap = f"{seconds} seconds"
    # A literal key would be folded away, and a session needs a key: this one is false for every event with a time.
    timer = (F.unix_micros(F.col("ts").cast("timestamp")) * 0 > 0).alias("timer")
    bursts = events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), timer).agg(F.count("*").alias("events"))
    return bursts.select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("fires_at"), "events")


def debounce_batch(events: DataFrame, seconds: int = C.DEBOUNCE_SECONDS) -> DataFrame:
    """The same over a table: events more than ``seconds`` after the last one begin a burst.

    Events are sorted in ranges of time, so no task holds more than a range, and a burst of any length is summed up in parts.
    """
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    numbered = bursts(events.where(F.col("ts").isNotNull()), "ts", gap)
    own = numbered.groupBy("burst").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return own.select(F.col("started").cast("timestamp_ntz").alias("started"), (F.col("last") + gap).cast("timestamp_ntz").alias("fires_at"), "events")


def outside_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events that arrive while no run (start_ts, end_ts) is active; those in [start_ts, end_ts) are dropped.

    Events and starts of runs are sorted in ranges of time, and an event looks at the latest end of all runs that have started by then; runs may be many, long and
    overlap. Events without a time are kept, runs without a start or an end drop nothing.
    """
    own, end, until = (runtime.spare_name(events, n) for n in ("is_event", "run_end", "until"))
    times = runs.where("start_ts IS NOT NULL AND end_ts IS NOT NULL")
    kind = events.schema["ts"].dataType
    starts = times.select(F.col("start_ts").cast(kind).alias("ts"), F.lit(False).alias(own), F.col("end_ts").cast(kind).alias(end))
    both = events.withColumn(own, F.lit(True)).unionByName(starts, allowMissingColumns=True)
    # A run that starts with an event comes before it. The rest of the order only makes ranges even.
    placed = running_max(both, F.col(end), "ts", own, F.xxhash64(*(c for c in events.columns)), name=until)
    free = F.col("ts").isNull() | F.col(until).isNull() | (F.col("ts") >= F.col(until))
    return placed.where(F.col(own) & free).select(*events.columns)


_RUNS = "open bigint, runs array<struct<s:bigint,e:bigint>>, held array<struct<ts:bigint,row:string>>"


def outside_runs_stream(events: DataFrame, runs: DataFrame, wait: str = "10 seconds", key: str | None = None) -> DataFrame:
    """The events of a stream (``ts`` and others) that arrive while no run is active, from a stream of runs (start_ts, end_ts).

    A run is told twice, without an end when it starts and with it when it is over, or once when it is over. An event is held until the watermark, ``wait`` behind the latest
    time seen, has passed it, and while a run that began before it goes on; then it comes out, or is dropped if it lies in [start_ts, end_ts) of a run. What is held and the
    runs that it may lie in are state, so a restart changes nothing. ``key`` names a column of both streams, such as the library, whose values go separately.
    """
    runtime.ship_package(events.sparkSession)
    schema = events.schema
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.col(key).cast("string") if key else F.lit("all")
    null = lambda kind: F.lit(None).cast(kind)
    told = events.select(own.alias("of"), F.col("ts").cast("timestamp").alias("at"), null("bigint").alias("s"), null("bigint").alias("e"), F.to_json(F.struct(*events.columns)).alias("row"))
    marks = runs.select(own.alias("of"), F.coalesce("end_ts", "start_ts").cast("timestamp").alias("at"), micros("start_ts").alias("s"), micros("end_ts").alias("e"), null("string").alias("row"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, spans, held = state.get if state.exists else (None, [], [])
        spans, held = [(int(x[0]), int(x[1])) for x in spans], [(int(x[0]), x[1]) for x in held]
        for rows in batches if not state.hasTimedOut else ():
            for at, s, e, row in zip(rows["at"], rows["s"], rows["e"], rows["row"], strict=True):
                if not pd.isna(row):
                    held.append((at.value // 1000, row))
                elif pd.isna(e):
                    begun = int(s) if begun is None else min(begun, int(s))
                else:
                    spans.append((int(s), int(e)))
                    # Runs don't overlap their own start, so the one that ends now is the one that is open.
                    begun = None if begun is not None and begun <= int(s) else begun
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in held if x[0] < passed and (begun is None or x[0] < begun)]
        held = [x for x in held if not (x[0] < passed and (begun is None or x[0] < begun))]
        out = sorted(x for x in ready if not any(s <= x[0] < e for s, e in spans))
        least = min([passed, *(x[0] for x in held)])
        spans = [x for x in spans if x[1] > least]
        state.update((begun, spans, held))
        if held:
            state.setTimeoutTimestamp(max(passed // 1000 + 1, max(x[0] for x in held) // 1000 + 1))
        yield pd.DataFrame({"row": [r for _, r in out]})

    marked = told.union(marks).withWatermark("at", wait)
    found = marked.groupBy("of").applyInPandasWithState(step, "row string", _RUNS, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("row", schema).alias("r")).select("r.*")
