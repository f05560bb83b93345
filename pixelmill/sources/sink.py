"""Objects by key as a transactional sink: ``df.write.format("pixelmill_objects")``, or ``writeStream``, with ``path``.

Rows are ``key string, content_type string, content binary``. A task writes its objects under a folder of its own attempt and a
list of them; the driver's commit is one file that names the lists, one for each task. Objects are there once that file is,
all of them or none: what a killed attempt, or a job that failed, left behind is in no list that counts. A stream's commit is
named by its batch, so that a batch that runs again takes its own place. ``committed`` gives each key once, the latest commit's;
``published`` puts these objects where their locations point, ``path/key``, by tasks.

Unsafe keys and rows without content fail the job. A commit with a greater ``seq`` (an option; a stream's is its batch's number)
counts over others, then the later one.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import tables
from ..functions import keys
from ..operators import store

NAME = "pixelmill_objects"
LISTED = "key string, object string, content_type string, n_bytes long"


def _put(uri: str, data: bytes, content_type: str | None = None) -> None:
    at = tables.local_path(uri)
    if at is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
    tables.write_bytes(uri, data, content_type)


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: where its list is, and how many objects it holds."""

    listed: str
    n: int


class _Objects:
    """Writes objects, lists them and commits the lists."""

    def __init__(self, base: str, seq: int, kind: str) -> None:
        self.base, self.seq, self.job = base.rstrip("/"), seq, f"{kind}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, lines = f"{self.base}/_staged/{self.job}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for key, kind, data in zip(*(batch.column(c) for c in ("key", "content_type", "content")), strict=True):
                key, kind, data = key.as_py(), kind.as_py(), data.as_py()
                if key is None or ".." in key or not re.match(keys.SAFE_KEY, key) or data is None:
                    raise ValueError(f"unsafe key or no content: {key!r}")
                path = f"{attempt}/{len(lines)}-{key.rsplit('/', 1)[-1]}"
                _put(path, data, kind)
                lines.append(json.dumps({"key": key, "object": path, "content_type": kind, "n_bytes": len(data)}))
        listed = f"{attempt}/list.json"
        if lines:
            _put(listed, "\n".join(lines).encode())
        return Written(listed, len(lines))

    def _commit(self, messages: list[Written | None], name: str, seq: int) -> None:
        held = {"seq": seq, "at": time.time_ns(), "lists": [m.listed for m in messages if m is not None and m.n]}
        _put(f"{self.base}/_commits/{name}.json", json.dumps(held).encode())


class BatchWriter(_Objects, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.job, self.seq)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing was committed; what is staged is no one's, and ``swept`` takes it."""


class StreamWriter(_Objects, DataSourceStreamArrowWriter):
    def __init__(self, base: str, query: str) -> None:
        super().__init__(base, 0, "stream")
        self.query = query

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"{self.query}-{batchId:012d}", batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass


class ObjectSink(DataSource):
    """Options: ``path``; ``seq`` of a batch write; ``query``, a stream's name in the commits, which must stay the same when it
    starts again."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("objects are added and replaced by key; use mode append")
        return BatchWriter(self.options["path"], int(self.options.get("seq", 0)), "batch")

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("query", "stream"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSink)


def write(derivatives: DataFrame, base: str, seq: int = 0) -> None:
    """Writes derivatives as objects, in one commit."""
    register(derivatives.sparkSession)
    derivatives.select("key", "content_type", "content").write.format(NAME).option("path", base).option("seq", seq).mode("append").save()


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = tables._fs(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, base: str) -> DataFrame:
    """(key, object, content_type, n_bytes), each key once: what the latest commit of the key holds."""
    base = base.rstrip("/")
    if not _there(spark, f"{base}/_commits"):
        return spark.createDataFrame([], LISTED)
    commits = spark.read.schema("seq long, at long, lists array<string>").json(f"{base}/_commits")
    lists = [r["list"] for r in commits.select(F.explode("lists").alias("list")).collect()]  # a row a task that wrote
    if not lists:
        return spark.createDataFrame([], LISTED)
    named = commits.select("seq", "at", F.explode("lists").alias("list")).select("seq", "at", F.substring_index("list", "/_staged/", -1).alias("list"))
    rows = spark.read.schema(LISTED).json(lists).withColumn("list", F.substring_index(F.col("_metadata.file_path"), "/_staged/", -1))
    rows = rows.join(F.broadcast(named), "list")
    return store.latest(rows.drop("list"), order=["seq", "at", "object"]).select("key", "object", "content_type", "n_bytes")


def published(spark: SparkSession, base: str) -> DataFrame:
    """Puts what is committed at ``base/key``; (key, n_bytes, error), a row a key, and nothing is copied before it is asked for.
    A task that runs again copies the same."""
    base = base.rstrip("/")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, path, kind in zip(*(batch.column(c).to_pylist() for c in ("key", "object", "content_type")), strict=True):
                try:
                    data = tables.read_bytes(path)
                    _put(f"{base}/{key}", data, kind)
                    out.append((key, len(data), None))
                except (OSError, ValueError) as e:
                    out.append((key, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "n_bytes", "error"])

    return committed(spark, base).select("key", "object", "content_type").mapInArrow(task, "key string, n_bytes long, error string")


def swept(spark: SparkSession, base: str, older_s: float = 86_400) -> int:
    """Deletes the staged folders of attempts that no commit names and that are older than ``older_s`` seconds; how many went."""
    base = base.rstrip("/")
    fs, staged = tables._fs(spark, f"{base}/_staged")
    if not fs.exists(staged):
        return 0
    named = set()
    if _there(spark, f"{base}/_commits"):
        commits = spark.read.schema("lists array<string>").json(f"{base}/_commits")
        named = {r["list"].split("/_staged/")[1].rsplit("/", 1)[0] for r in commits.select(F.explode("lists").alias("list")).collect()}
    gone = 0
    for job in fs.listStatus(staged):
        for attempt in fs.listStatus(job.getPath()):
            name = f"{job.getPath().getName()}/{attempt.getPath().getName()}"
            if name not in named and attempt.getModificationTime() / 1000 < time.time() - older_s:
                fs.delete(attempt.getPath(), True)
                gone += 1
    return gone
