"""Tables and files in the folder that driver and executors share: lineage cuts, and what Python workers write and read."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    import atexit

    path = tempfile.mkdtemp(prefix="pixelmill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a single-machine session (``local[...]``) gets a scratch folder that goes at exit; a cluster
    gets a folder in the warehouse, and an error where the warehouse is in a machine's own file system, as by default.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_scratch()
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pixelmill"
    if _fs(spark, path)[0].getScheme() == "file":
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {path} is a machine's own")
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: The folders of the scope that this thread is in; other threads, a stream's say, have scopes of their own or none.
_made: ContextVar[list[str] | None] = ContextVar("pixelmill_made", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Names of folders that this thread makes inside; those that are still listed at the end go then."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(outer)
        for path in made:
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; the folder goes when this thread's scope, or else the driver, ends."""
    path = f"{shared_dir(spark)}/pixelmill-{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: later jobs start from the files, whichever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or a bare path, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _store(uri: str):
    """The file system and path of a URI, for Python workers. Hadoop's names of object stores are known by another name."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{({'s3a': 's3', 's3n': 's3'}).get(scheme, scheme)}://{rest}")


def write_bytes(uri: str, data: bytes, content_type: str | None = None) -> None:
    """Writes one file whole, from any Python worker: other readers see all of it or nothing. Object stores keep the
    content type, file systems do not."""
    path = local_path(uri)
    if path is not None:
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    store, path = _store(uri)
    if store.type_name in ("s3", "gcs", "abfs"):  # an object appears whole, once it is closed
        with store.open_output_stream(path, metadata={"Content-Type": content_type} if content_type else None) as f:
            f.write(data)
        return
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_bytes(uri: str) -> bytes:
    """One whole file, in any Python worker."""
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    store, path = _store(uri)
    with store.open_input_stream(path) as f:
        return f.read()
