"""The batch plan: validate, key, probe, deduplicate, fetch, derive, store, locate.

The probe and the deduplication stand before the pixel step by construction, as Spark does not move them below a UDF.
Joins are on keys and urls; image bytes never pass a shuffle but the one that brings a source to its request. Sources are
a table or are fetched: ``lambda work: http.fetched(work, hosts)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation, functions as F

from .. import tables
from ..operators import keyed, metrics, placing, process, requests as req, store

Sources = DataFrame | Callable[[DataFrame], DataFrame]


def prepared(raw: DataFrame, sub_path: str = "") -> DataFrame:
    """Requests with ``error`` and, where good, ``key`` and the plan columns."""
    checked = req.planned(req.with_key(req.normalised(req.validated(raw)), sub_path))
    return checked.withColumn("key", F.when(F.col("error").isNull(), F.col("key")))


def work_list(requests: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Good requests that are not stored yet, one a key."""
    good = requests.where(F.col("error").isNull()).drop("error")
    return req.deduplicated(store.misses(good, derivatives))


def derived(work: DataFrame, sources: Sources, max_bytes: int, profile: ResourceProfile | None = None, task_bytes: int | None = None) -> DataFrame:
    """(key, content_type, content, error, out_width, out_height, made_ms) of the work list; sources: url, status,
    content_length, content and perhaps error, or a function that makes them of rows with ``url``. A source meets all that is
    asked of it at once, and is decoded once. ``task_bytes``: what a pixel task's sources and derivatives come to, about."""
    asked = process.by_source(work)
    sources = sources(asked) if callable(sources) else sources
    guarded = store.guarded(sources, max_bytes)
    if task_bytes is not None:
        sized = asked.join(guarded.select("url", "content_length"), "url", "left") if "content_length" in guarded.columns else asked.withColumn("content_length", F.lit(None).cast("long"))
        weighed = sized.withColumn("weight", placing.pixel_weight(F.col("asked"), F.col("content_length"))).drop("content_length")
        asked, _ = tables.cut(placing.binned(weighed.withColumn("first", F.col("asked")[0]["key"]), ["url", "first"], "weight", task_bytes), "bins")
    met = asked.join(guarded.select("url", F.col("content").alias("source"), F.col("error").alias("source_error")), "url", "left")
    met = met if task_bytes is None else placing.placed(met)
    return process.derived(met.withColumn("source", F.when(F.col("source_error").isNull(), F.col("source"))), profile)


def resize_batch(raw: DataFrame, sources: Sources, store_path: str | keyed.Store, base: str, max_bytes: int = 50 << 20, sub_path: str = "", seq: int = 0, observation: Observation | None = None, profile: ResourceProfile | None = None, task_bytes: int | None = None) -> DataFrame:
    """Answers requests and stores what was missing: (request_id, key, cached, location, error), a row a request.

    What is made is written before it is stored, and what was cached is written before the store grows, so pixels are made
    once, whichever executor is lost, and the answer does not follow the store. Both are in the shared folder until the
    driver, or the scope that this is called in, ends. ``store_path``: a folder of writes, or a store by key, of which only the
    buckets that are asked for are read. ``observation``: gets the counters of ``metrics`` from the job that writes the answer;
    ``profile``, ``task_bytes``: see ``process.derived`` and ``derived``.
    """
    known = prepared(raw, sub_path)
    stored = store_path.near(known) if isinstance(store_path, keyed.Store) else store.read(raw.sparkSession, store_path, probing=True)
    work, _ = tables.cut(work_list(known, stored), "work")
    new, _ = tables.cut(derived(work, sources, max_bytes, profile, task_bytes), "derived")
    failed = new.where(F.col("error").isNotNull()).select("key", F.col("error").alias("made_error"))
    cached = store.probed(known.select("request_id", "url", "key", "error"), stored).withColumnRenamed("found", "cached")
    answer = cached.join(failed, "key", "left").withColumn("error", F.coalesce("error", "made_error")).drop("made_error")
    answer, _ = tables.cut(answer if observation is None else metrics.observed(answer, observation), "answer")
    made = new.where(F.col("error").isNull())
    if isinstance(store_path, keyed.Store):
        store_path.append(made, seq)
    else:
        store.append(made, store_path, seq)
    located = store.located(answer.withColumn("found", F.col("error").isNull()), base)
    return located.select("request_id", "key", "cached", "location", "error")
