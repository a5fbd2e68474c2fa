"""Online assignment of arriving faces to persons, with one running mean for each person as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinfold import constants as C
from kinfold import runtime
from kinfold.operators.clustering import RunningMeans

_STATE = "names array<bigint>, means array<array<float>>, counts array<bigint>"


def assign_stream(faces: DataFrame, threshold: float = C.COSINE_THRESHOLD, shards: str | None = None) -> DataFrame:
    """(shard, face_id, person_id) of a stream of faces (id, embedding), in order of id within each batch.

    Persons are opened as negative ids. ``shards`` names a column whose values are clustered independently, such as
    the library; without it there is one sequence, as the result depends on all faces before.
    """
    runtime.ship_package(faces.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        means = RunningMeans()
        if state.exists:
            means.load(*(list(x) for x in state.get))
        rows = pd.concat(list(batches)).sort_values("id")
        found = [means.assign(np.asarray(v, dtype=np.float32), threshold) for v in rows["embedding"]]
        state.update((means.names, means.means().tolist(), means.counts))
        yield pd.DataFrame({"shard": key[0], "face_id": rows["id"], "person_id": found})

    shard = F.col(shards).cast("string") if shards else F.lit("all")
    return faces.withColumn("shard", shard).groupBy("shard").applyInPandasWithState(step, "shard string, face_id bigint, person_id bigint", _STATE, "append", GroupStateTimeout.NoTimeout)
