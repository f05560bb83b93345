"""Counters of running plans, without a pass of their own: requests, hits, misses, errors and the hit ratio."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAMES = ("requests", "hits", "misses", "errors")


def observed(answers: DataFrame, where: Observation | str, hit: str = "cached", error: str = "error is not null") -> DataFrame:
    """``answers``, of which the next action (or each batch, of a stream) counts rows on its way into ``where``."""
    hit, error = F.expr(hit), F.expr(error)
    counts = [F.count(F.lit(1)), F.count_if(hit), F.count_if(~hit & ~error), F.count_if(error)]
    return answers.observe(where, *[c.alias(n) for c, n in zip(counts, NAMES, strict=True)])


def ratio(counts: dict) -> float:
    """Hits among hits and misses; 0 without any."""
    met = counts["hits"] + counts["misses"]
    return round(counts["hits"] / met, 9) if met else 0.0


class Running(StreamingQueryListener):
    """Sums of what queries counted under ``name``, while they run and after; a batch's counts come shortly after it. A batch that runs
    again counts once."""

    def __init__(self, name: str) -> None:
        self.name, self.lock = name, threading.Lock()
        self.batches: dict[tuple, dict] = {}

    @property
    def counts(self) -> dict:
        with self.lock:
            out = {n: sum(b[n] for b in self.batches.values()) for n in NAMES}
        return out | {"hit_ratio": ratio(out)}

    def add(self, query, batch: int, found: dict) -> None:
        with self.lock:
            self.batches[query, batch] = {n: found.get(n) or 0 for n in NAMES}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.add(event.progress.id, event.progress.batchId, found.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
