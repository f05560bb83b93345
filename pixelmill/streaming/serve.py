"""Continuous requests: the batch plan on every micro-batch. The store is the only state, so there are no watermarks.

A micro-batch that runs again finds what it stored before; a key that two batches both made is written twice, and the
latest write counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery

from .. import tables
from ..operators import keyed, metrics
from ..plans import resize


def serve(requests: DataFrame, sources: resize.Sources, store_path: str | keyed.Store, answers_path: str, checkpoint: str, base: str, once: bool = True, compact_every: int = 50, running: metrics.Running | None = None) -> StreamingQuery:
    """Answers a stream of requests; answers go to ``answers_path/batch=N``, overwritten if a batch runs again. A store by key is
    compacted after every so many batches, so that a probe's cost does not follow their number. ``running``: gets each batch's counters."""

    def batch(df: DataFrame, n: int) -> None:
        seen = None if running is None else Observation()
        with tables.scope(df.sparkSession):  # what a micro-batch wrote on its way goes with it
            resize.resize_batch(df, sources, store_path, base, seq=n, observation=seen).write.mode("overwrite").parquet(f"{answers_path}/batch={n}")
        if running is not None:
            running.add(checkpoint, n, seen.get)
        if isinstance(store_path, keyed.Store) and n % compact_every == compact_every - 1:
            store_path.compact()

    out = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()
