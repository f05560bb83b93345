"""The derivative store as a table: probe, lookup, latest write, source guards."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import tables
from ..functions import formats, keys

DERIVATIVES = "key string, content_type string, content binary, seq long"


def hits(requests: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Requests whose key is stored. Only keys take part in the join."""
    return requests.join(derivatives.select("key"), "key", "left_semi")


def misses(requests: DataFrame, derivatives: DataFrame) -> DataFrame:
    return requests.join(derivatives.select("key"), "key", "left_anti")


def probed(requests: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Requests with ``found``, in one pass."""
    stored = derivatives.select("key", F.lit(True).alias("found")).distinct()
    return requests.join(stored, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest(derivatives: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """The last write of each key. An aggregate, not a window: it combines before the shuffle and a hot key is one row a task."""
    rest = [c for c in derivatives.columns if c != key]
    by = F.struct(*(order or ["seq"]))
    return derivatives.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, "r.*")


def located(probed_requests: DataFrame, base: str) -> DataFrame:
    """``location``: the derivative's url, or the original url where there is none."""
    url = keys.cdn_url(F.lit(base), F.col("key"))
    return probed_requests.withColumn("location", F.coalesce(F.when(F.col("found"), url), F.col("url")))


def downloaded(wanted: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Keys with their bytes: found, content (empty where missing or unsafe), content_type, cache_control, error.

    The store's rows meet the wanted keys before anything is sorted or shuffled by key, so no other key's bytes are."""
    asked = wanted.select("key").where(keys.safe_key(F.col("key")))
    held = latest(derivatives.join(asked, "key", "left_semi"))
    out = wanted.withColumn("__safe", keys.safe_key(F.col("key"))).join(held.select("key", "content", "content_type", F.lit(True).alias("__found")), "key", "left")
    found = F.coalesce(F.col("__found") & F.col("__safe"), F.lit(False))
    return out.select(
        *wanted.columns,
        found.alias("found"),
        F.coalesce(F.when(found, F.col("content")), F.lit(b"")).alias("content"),
        F.when(found, F.coalesce("content_type", F.lit(formats.OCTETS))).alias("content_type"),
        F.when(found, F.lit(formats.CACHE_CONTROL)).alias("cache_control"),
        F.when(~F.col("__safe"), F.lit("unsafe key")).when(~found, F.lit("not found")).alias("error"),
    )


def guarded(sources: DataFrame, most: int) -> DataFrame:
    """Sources with ``error``: their own, if they have one; status outside 2xx, or a declared length over ``most`` (an
    unknown length passes)."""
    bad = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "status").when(F.col("content_length") > most, "too large")
    return sources.withColumn("error", F.coalesce("error", bad) if "error" in sources.columns else bad)


def read(spark: SparkSession, path: str, kind: str = "s3", probing: bool = False) -> DataFrame:
    """The stored derivatives. A store that is not there is empty. Any other error is the caller's, but for stores of kind
    ``local``, and where the store is only probed before work that would make what is missing: these count as empty."""
    try:
        return spark.read.schema(DERIVATIVES).parquet(path)
    except (PySparkException, Py4JJavaError) as e:  # the latter are a file system's own
        if isinstance(e, Py4JJavaError) or e.getCondition() != "PATH_NOT_FOUND":
            if kind != "local" and not probing:
                raise
            logging.getLogger(__name__).warning("store %s cannot be read, taken as empty: %s", path, e)
        return spark.createDataFrame([], DERIVATIVES)


def append(derivatives: DataFrame, path: str, seq: int = 0) -> None:
    derivatives.select("key", "content_type", "content", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(path)


# The store as one object a key, under ``base/key``.


def put_objects(derivatives: DataFrame, base: str) -> DataFrame:
    """Writes each row's content to ``base/key``, folders made as needed; (key, n_bytes, error), a row a row, and nothing is
    written before it is asked for. An object is there whole or not at all, and a task that runs again writes the same.
    Object stores keep the content type. Unsafe keys are refused."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, safe, content_type, content in zip(*(batch.column(c) for c in ("key", "safe", "content_type", "content")), strict=True):
                key, data = key.as_py(), content.as_py()
                error = None if safe.as_py() else "unsafe key"
                if error is None and data is None:
                    error = "no content"
                if error is None:
                    try:
                        at = tables.local_path(f"{base.rstrip('/')}/{key}")
                        if at is not None:
                            os.makedirs(os.path.dirname(at), exist_ok=True)
                        tables.write_bytes(f"{base.rstrip('/')}/{key}", data, content_type.as_py())
                    except (OSError, ValueError) as e:
                        error = str(e)
                out.append((key, None if error else len(data), error))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "n_bytes", "error"])

    return derivatives.select("key", keys.safe_key(F.col("key")).alias("safe"), "content_type", "content").mapInArrow(task, "key string, n_bytes long, error string")


def objects(spark: SparkSession, base: str) -> DataFrame:
    """(key, content_type, content, seq) of the objects under ``base`` whose keys are safe; the content type follows the
    key's ending, ``seq`` the time of the last write. Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    root = base.rstrip("/").split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    key = F.substring_index("path", root, -1)
    ending = F.substring_index("path", ".", -1)
    found = files.select(key.alias("key"), formats.media_type(ending).alias("content_type"), "content", F.unix_micros("modificationTime").alias("seq"))
    return found.where(keys.safe_key(F.col("key")))
