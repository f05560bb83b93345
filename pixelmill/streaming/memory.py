"""The store as a stream's own state: derivatives are values by cache key in the state store, and no file is probed.

A key's requests of all batches meet in one place, so a key that two batches ask for is made once and held once. What is held
answers, also after a restart from the checkpoint. What fails is not held and is tried again with the next request. A source is
loaded by the task that needs it, and only for a key that is not held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import tables
from ..operators import metrics, process
from ..plans import resize
from ..sources import config, http

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWERS = "request_id long, key string, cached boolean, location string, error string"
#: Of a url its bytes, or what is wrong.
Loader = Callable[[str], tuple[bytes | None, str | None]]


def over_http(hosts: Iterable[str], settings: config.Performance | None = None) -> Loader:
    settings, hosts = settings or config.Performance(), {h.lower() for h in hosts}

    def load(url: str) -> tuple[bytes | None, str | None]:
        _, _, _, content, error = http.fetch(url, hosts, float(settings.http_timeout_s), settings.max_image_bytes)
        return content, error

    return load


def from_files(root: str) -> Loader:
    """Urls ``http://host/name`` as files ``root/name``."""

    def load(url: str) -> tuple[bytes | None, str | None]:
        try:
            return tables.read_bytes(f"{root.rstrip('/')}/{url.rsplit('/', 1)[-1]}"), None
        except OSError as e:
            return None, f"no source: {type(e).__name__}"

    return load


class Derivatives(StatefulProcessor):
    """Of each key: its derivative, once it is made."""

    def __init__(self, load: Loader, base: str, ttl_s: int | None) -> None:
        self.load, self.base, self.ttl_s = load, base.rstrip("/"), ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "content_type string, content binary", self.ttl_s and self.ttl_s * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cached, made, error = self.held.exists(), False, None
        for part in rows:
            if not cached and not made:
                first, made = part.iloc[0], True
                content, error = self.load(first["url"])
                if error is None:
                    content, _, _, error, _ = process.made(content, *(first[c] for c in process.STEPS))
                if error is None:
                    self.held.update((first["content_type"], content))
            location = part["url"] if error else f"{self.base}/{key[0]}"
            yield pd.DataFrame({"request_id": part["request_id"], "key": key[0], "cached": cached, "location": location, "error": error}).astype({"error": "object"})

    def close(self) -> None:
        pass


def answered(requests: DataFrame, load: Loader, base: str, sub_path: str = "", ttl_s: int | None = None) -> DataFrame:
    """A stream of requests as a stream of (request_id, key, cached, location, error). ``cached``: held before the batch;
    ``ttl_s``: seconds after which a derivative is forgotten."""
    known = resize.prepared(requests, sub_path)
    good = known.where("error is null").drop("error").groupBy("key")
    out = good.transformWithStateInPandas(statefulProcessor=Derivatives(load, base, ttl_s), outputStructType=ANSWERS, outputMode="append", timeMode="processingTime" if ttl_s else "none")
    bad = known.where("error is not null").select("request_id", "key", F.lit(False).alias("cached"), F.col("url").alias("location"), "error")
    return out.unionByName(bad)


def serve(requests: DataFrame, load: Loader, answers_path: str, checkpoint: str, base: str, once: bool = True, name: str | None = None, **options) -> StreamingQuery:
    """Answers a stream of requests to Parquet; ``name``: counters that ``metrics.Running`` picks up while it runs."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = answered(requests, load, base, **options)
    out = out if name is None else metrics.observed(out, name)
    out = out.writeStream.format("parquet").option("path", answers_path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start() if once else out.start()
